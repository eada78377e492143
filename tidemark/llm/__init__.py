"""Operators for large training corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with their code, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
