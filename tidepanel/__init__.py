"""Panels of time series on Spark: returns, symbols, alignment, grouping, allocation and walk-forward studies."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
