"""Operators for large training-data pipelines, each one a function from DataFrames to DataFrames.

Functions that run inside tasks travel by value, so executors need not have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
