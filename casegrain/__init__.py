"""casegrain: a Spark-first analytics engine for episodes and the data around them."""

import sys

from pyspark import cloudpickle

# Arrow functions go to the executors by value, so they need no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
