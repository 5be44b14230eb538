"""Document retrieval and prompt building over large corpora, as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The small functions that run in Python workers travel with their task, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
