"""Helpers of the corpus operators: tables in the shared folder, bounded Arrow chunks, checked broadcasts."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.session import checkpoint_dir

#: Rows up to which a table may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 300_000
#: Spark's setting for shuffle files that go with the query that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/runsift-{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """The table read again, and its path. Spark removes the shuffle files of the job as it ends, not when the driver collects garbage."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there and a lost executor costs nothing."""
    return _written(df, name)[0]


class Steps:
    """Tables written between the jobs of one operator, in the shared folder. ``drop`` removes those that nothing reads any more:
    call it only when what was made of them is stored. Tables that the operator's result reads stay."""

    def __init__(self) -> None:
        self._paths: list[tuple[DataFrame, str]] = []

    def store(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by``: a column that the table is partitioned by."""
        out, path = _written(df, name, by)
        self._paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df, path in [x for x in self._paths if any(x[0] is t for t in tables)]:
            spark = df.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        self._paths = [x for x in self._paths if not any(x[0] is t for t in tables)]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a stored table of a few plain columns if it has at most ``rows`` rows; else leave it to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (string or binary) holds about ``most`` bytes at a time, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = sizes.cumsum()
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(ends.searchsorted(before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the checkpoint folder that all machines share; Spark removes it when no longer used."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def summed(df: DataFrame, column: str, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None], most: int = 1 << 20) -> np.ndarray:
    """One integer array of fixed ``size`` (a multiple of 64) summed over all rows.

    ``add`` puts a chunk of rows into its task's array. The arrays are cut into 64 blocks and added in two steps, so no task
    gets more than a share of them; what comes to the driver is one array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        for batch in chunks(batches, column, most):
            add(total, batch)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(64), pa.int32()), "part": pa.array([TaskContext.get().partitionId() % 61] * 64, pa.int32()),
                                          "sums": pa.array([zlib.compress(x.tobytes(), 1) for x in total.reshape(64, -1)], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(size // 64, np.int64)
        for x in table.column("sums").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.int64)
        return pa.table({"block": table.column("block")[:1], "part": pa.array([0], pa.int32()), "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "block int, part int, sums binary"
    out = np.zeros((64, size // 64), np.int64)
    for r in df.mapInArrow(run, schema).groupBy("block", "part").applyInArrow(merge, schema).groupBy("block").applyInArrow(merge, schema).collect():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["sums"]), np.int64)
    return out.ravel()
