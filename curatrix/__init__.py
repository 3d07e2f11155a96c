"""curatrix: curation analytics for labelled text and vectors on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
