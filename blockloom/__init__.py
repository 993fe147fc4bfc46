"""Block-parallel lossless compression and byte analytics over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
