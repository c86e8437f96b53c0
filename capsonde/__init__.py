"""Capability-probe analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions which run in Python workers travel with the job, so that a cluster needs no copy
# of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
