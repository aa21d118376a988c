"""Decision-data analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions for Python workers travel by value: executors need not have this package.
register_pickle_by_value(sys.modules[__name__])
