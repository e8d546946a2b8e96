"""A PySpark-native engine for timelines from sampled signals and event sequences."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
