"""Training-data operators: text cleaning, near-duplicates, search, tokenising and packing.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
