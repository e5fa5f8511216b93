"""Tabular machine-learning data work as PySpark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
