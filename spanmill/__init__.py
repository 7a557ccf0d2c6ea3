"""Profile analytics on Spark: event features, two-period profiles, retrieval and its uncertainty."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
