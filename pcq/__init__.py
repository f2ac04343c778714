"""pcq: a PySpark-native analytics engine for 3-D point tables."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
