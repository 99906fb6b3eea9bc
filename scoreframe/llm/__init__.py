"""Operators for building training corpora, and the queries that apply them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the jobs; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
