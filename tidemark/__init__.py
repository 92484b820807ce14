"""Spark-native analytics for social-media text."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so the package need not be
# installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
