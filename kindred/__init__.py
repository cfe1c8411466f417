"""Kindred: near-duplicate detection and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle as _cloudpickle

#: Functions that run in Python workers travel with the task: executors need no
#: installed copy of this package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
