"""Spatial scene analytics and knowledge-graph upkeep on Spark."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions that run in Python workers travel with their code, so that a cluster
# needs no copy of this package on its executors.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
