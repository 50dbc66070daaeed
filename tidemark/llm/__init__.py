"""Operators for preparing training data: duplicates, filters, packing, search."""

import sys

from pyspark import cloudpickle

# What tasks run is sent along, so executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
