"""Market tick analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to Python workers travel whole, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
