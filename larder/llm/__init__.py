"""Operators for preparing training text at scale. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
