"""Training-data operators: sharding, dedup, filters, chat formatting, tokenising.

Functions of this package travel to Python workers by value, so executors need
no copy of the repository on their path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
