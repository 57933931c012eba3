"""Panel, interval and weighted-regression operators as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel to executors by value, so the package needs no install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
