"""Operators of a training-data pipeline: counts, scores, filters, searches and deduplication.

Each module holds one operator as DataFrame-in, DataFrame-out functions; ``queries`` applies
them to the given tables.  Functions that run in Python workers are shipped by value, so the
executors need numpy and pyarrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
