"""A PySpark engine for recorded process and file traces."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
