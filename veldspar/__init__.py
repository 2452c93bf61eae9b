"""Spark-native document question answering and training-data preparation."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: these need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
