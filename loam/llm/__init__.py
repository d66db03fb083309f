"""Operators for large training-data pipelines. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors get these functions with the job, so they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
