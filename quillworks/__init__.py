"""Quillworks: checks written prose at corpus scale on Spark, and measures how well the checks work."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its functions are sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
