"""Tidemark: a PySpark-native engine for append-only event analytics.

Functions sent to executors are pickled by value, so that workers need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
