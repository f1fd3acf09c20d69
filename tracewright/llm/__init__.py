"""Operators that prepare text corpora for training, one module each.

Functions of this package run on executors that may not have it installed, so
they are shipped by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
