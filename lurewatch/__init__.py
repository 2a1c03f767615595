"""Email threat analytics as Spark DataFrame transforms."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with their tasks, so that workers need no copy of
# the package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
