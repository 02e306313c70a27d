"""marlstone: documentation retrieval and C/C++ code mapping as Spark jobs."""

import sys

from pyspark import cloudpickle

# Worker-side helpers travel inside the serialized task, so executors need no
# copy of this package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
