import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from runsift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


@pytest.fixture(scope="session")
def apply(spark):
    """apply(fn, text, ...) -> value of a column expression on one row."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        cols = [f"c{i}" for i in range(len(values))]
        types = ", ".join(f"{c} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}"
                          for c, v in zip(cols, values, strict=True))
        return spark.createDataFrame([tuple(values)], types).select(fn(*[F.col(c) for c in cols]).alias("v")).first()[0]
    return run
