"""lexiloom: document retrieval and corpus preparation as DataFrame programs.

Functions that Spark ships to Python workers are pickled by value, so executors
need only PySpark, Arrow and numpy: the package itself is not installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
