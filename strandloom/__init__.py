"""strandloom: interval analytics and training-data operators as Spark jobs."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Task functions travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
