"""Parallel-text curation and corpus preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Functions go to executors with their code, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
