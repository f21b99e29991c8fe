"""loomwork: a PySpark-native engine for content catalogues, scheduled delivery and text corpora.

Functions that run inside Python workers are pickled by value, so that a job
works whether or not this package is installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
