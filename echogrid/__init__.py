"""Gridded radar analytics expressed as PySpark DataFrame operators.

Cells are rows, a frame is a group of rows, and every raster step is a
projection, a keyed join, an aggregate or a bounded tile group.
"""

import sys

from pyspark import cloudpickle

# The small functions that run inside tasks travel by value, so executors need
# no copy of this package and jobs may be started from any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
