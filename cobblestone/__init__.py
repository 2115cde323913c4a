"""Cobblestone: road-network and city-raster analytics as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Kernels used in applyInPandas/mapInPandas travel with the closure, so executors
# need no copy of this package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
