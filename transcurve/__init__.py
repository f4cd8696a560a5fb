"""Transition-curve analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code: workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
