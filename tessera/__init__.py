"""Tessera: column tables, binned aggregates and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so a session need not ship the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
