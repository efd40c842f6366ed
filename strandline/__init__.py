"""Genome sequence and annotation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
