"""Spectral perception analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the package inside each task, so executors need nothing but pyspark, numpy and pyarrow installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
