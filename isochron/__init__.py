"""isochron: transit-schedule and network analytics expressed on Spark DataFrames.

Functions that run on executors are pickled by value, so a cluster needs no
copy of this package beside Spark and the third-party wheels.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
