"""Operators of a training-data pipeline. Nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a cluster needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
