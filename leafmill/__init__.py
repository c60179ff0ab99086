"""A document query and changes engine on Apache Spark."""

import sys

from pyspark import cloudpickle

# functions travel to Python workers by value: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
