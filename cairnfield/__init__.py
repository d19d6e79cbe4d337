"""cairnfield: mutable 3-D point collections as immutable Spark DataFrame states."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors get this package's functions with the task and need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
