"""Training-data operators: one module per operator, plus the queries over them."""

import sys

from pyspark import cloudpickle

# Functions that run inside Spark tasks travel by value, so executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
