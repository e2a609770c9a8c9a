"""Operators for building language-model training data from document tables.

Nothing else in the library imports this package. Functions that run inside tasks are sent to the executors by value,
so that a cluster needs no copy of the package on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
