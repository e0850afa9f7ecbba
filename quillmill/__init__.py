"""Document retrieval, analytics and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# What tasks run goes to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
