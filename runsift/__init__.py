"""runsift: Spark jobs over captured command runs and agent sessions."""

import sys

from pyspark import cloudpickle

# Arrow helpers travel inside the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
