"""Operators for training-data pipelines; `registry` has their queries."""

import sys

from pyspark import cloudpickle

# Send the functions of this package to Python workers as code, as workers need not have it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
