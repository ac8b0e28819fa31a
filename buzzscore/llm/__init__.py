"""Operators of a training-data pipeline.  Nothing else in the library imports this package."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions travel to the executors by value, so that executors need not
# have this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
