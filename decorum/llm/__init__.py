"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Workers get the code of this package with each task and need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
