"""Training-data operators: ten building blocks and their digest queries.

Nothing outside this folder imports it.  Functions that run in Python workers
are pickled by value, so executors need not have this repository installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
