"""Spark DataFrame operators for preparing, sampling and evaluating audio corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value, so executors and
# streaming workers do not need the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
