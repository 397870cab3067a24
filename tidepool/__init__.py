"""tidepool: panel time-series preparation, evaluation and monitoring on Spark.

Every operator is a function from DataFrame(s) to a DataFrame; nothing is
collected to the driver except bounded, one-row scalars where noted.
"""

import sys

from pyspark import cloudpickle

from tidepool.session import get_spark, checkpoint_dir

# functions that run inside Spark tasks travel by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "checkpoint_dir"]
