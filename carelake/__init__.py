"""Health-reference data engine: plain ``DataFrame -> DataFrame`` functions on Spark.

The few functions that run Python inside tasks are shipped by value, so
executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
