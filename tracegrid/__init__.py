"""Spark operators for engineering tables, documents and training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions sent to the workers travel whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
