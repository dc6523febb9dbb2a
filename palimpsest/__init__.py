"""Spark-native conversation-memory engine."""

import sys

from pyspark import cloudpickle

# Python functions travel with the job by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
