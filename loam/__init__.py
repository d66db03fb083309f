"""loam: corpus, retrieval and accounting operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the library's functions with the job, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
