"""Page-level document text analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors travel by value: no executor needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
