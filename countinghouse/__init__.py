"""Ledger analytics on Spark DataFrames.

Functions that run in Python workers are shipped by value, so that a cluster
needs no installed copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
