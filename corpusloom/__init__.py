"""A Spark-native engine for analysing a research-literature corpus."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: what their Python workers run travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
