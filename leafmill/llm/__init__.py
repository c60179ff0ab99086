"""Training-data operators: deduplication, mixing, token counts, classifiers, media, URL filters, BPE.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# functions travel to Python workers by value: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
