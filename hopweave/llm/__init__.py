"""Operators of a training-data pipeline."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors then need no copy of this package
