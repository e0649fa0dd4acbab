"""Spark-native tiled processing of large volumetric arrays."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to executors by value, so only the driver needs it installed.
register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
