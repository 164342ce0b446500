"""Review-text analytics as Spark DataFrame, SQL and ML jobs."""

import sys

from pyspark import cloudpickle

# The few helpers that run in Python tasks travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
