"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
