"""Preparation, checking, classification and evaluation of labelled utterances on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the few functions they run by value: executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
