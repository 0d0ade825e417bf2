"""Interview-preparation analytics as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions used inside tasks travel by value, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
