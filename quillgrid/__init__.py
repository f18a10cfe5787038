"""Quillgrid: analytics over positioned documents and text corpora, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: executors need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
