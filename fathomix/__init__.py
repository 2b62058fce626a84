"""A PySpark engine for indexing, searching and cleaning source files and documents."""

import sys

from pyspark import cloudpickle

# Functions of this library travel to the Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
