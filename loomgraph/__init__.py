"""Spark-native planning of comparison networks.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column expressions),
``operators`` (pair generation, gates, graph and numeric operators), ``plans`` (options,
planners and the end-to-end query), ``streaming`` (incremental forms).
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run on executors travel with the job, so executors need no
# copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
