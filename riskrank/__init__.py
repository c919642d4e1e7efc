"""Text-plus-metadata ranking on Spark.

Functions of this package travel to executors by value, so that a cluster's workers need
no copy of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
