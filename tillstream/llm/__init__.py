"""Operators for text corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions and classes of this package travel to the executors by value, inside the functions that use
# them, so that workers need no copy of it. Broadcasts do not: they hold plain data only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
