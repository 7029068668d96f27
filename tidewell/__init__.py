"""tidewell: a PySpark-native analytics engine.

Layers: ``sources`` (tables, object store), ``operators`` (joins, ranges,
search, statistics), ``functions`` (column-level helpers), ``plans`` (query
suites and their oracle SQL), ``streaming`` (incremental ingest).

Functions of this package that run inside Python workers are shipped by value,
so executors need no copy of the package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
