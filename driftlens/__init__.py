"""Event-log analytics as DataFrame and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The small functions that run inside tasks travel with the task, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
