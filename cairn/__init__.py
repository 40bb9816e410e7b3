"""Spatial-hierarchy analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Python workers need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
