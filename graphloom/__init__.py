"""Graph, edge-event and embedding analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# kernels travel to the executors with their code, so the package needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
