"""Transit monitoring analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
