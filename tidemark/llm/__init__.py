"""Operators for large text corpora; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get these modules by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
