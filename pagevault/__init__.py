"""Spark-native archive of visited pages and documents, with chunking and nearest-neighbour search."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
