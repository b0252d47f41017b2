"""Sextant: grounded retrieval analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: their Python need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
