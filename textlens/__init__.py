"""textlens: Spark-native text-classification data work.

Every public operator takes and returns DataFrames (or Columns) and is built
from Spark SQL / DataFrame primitives, Spark ML, and Arrow-batched pandas
functions only where a pluggable model has to run.
"""

import sys as _sys

from textlens.session import get_session, scratch_dir

# Functions shipped to Python workers (mapInPandas / applyInPandas bodies,
# predictors) are pickled by value, so executors need no installed copy of
# this package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover - older cloudpickle
    pass

__all__ = ["get_session", "scratch_dir"]
