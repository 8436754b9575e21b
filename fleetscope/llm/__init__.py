"""Operators for large text corpora."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's functions, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
