"""A PySpark-native record-linkage and corpus-preparation engine."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
