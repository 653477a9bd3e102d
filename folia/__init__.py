"""A PySpark-native analytics engine for structured document libraries."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
