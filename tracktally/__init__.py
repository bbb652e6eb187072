"""Event-track analytics and count forecasting as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no
# copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
