"""Building and measuring training corpora on Spark."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions they need, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
