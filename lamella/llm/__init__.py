"""Operators for large-scale training-data pipelines. Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need only the third-party libraries.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
