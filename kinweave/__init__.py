"""kinweave: record linkage and analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python kernels travel to the executors by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
