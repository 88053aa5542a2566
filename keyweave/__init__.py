"""Keyweave: batch identifier lookup, entity resolution and table enrichment on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions travel to the executors by value: a cluster needs no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
