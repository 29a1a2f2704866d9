"""Operators for preparing language-model training data; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# executors need no copy of this package: functions that run inside tasks travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])
