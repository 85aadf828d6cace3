"""Tensor and sequence analytics on Spark: tensors are relations, their operators are DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
