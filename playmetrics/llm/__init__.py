"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its own general interface (DataFrame in,
DataFrame out); `queries` holds the thin registered queries and their SQL.
Nothing else in the library imports this package. Its task functions travel
by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
