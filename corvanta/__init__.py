"""Corvanta: a PySpark-native engine for document retrieval and corpus work.

Functions that run on executors are sent by value, so a cluster needs no copy
of this package on its nodes.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
