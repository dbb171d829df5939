"""knotweave: a PySpark-native retrieval, graph and corpus engine."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that executors
# need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
