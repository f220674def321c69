"""Catalogue search, aggregation and ingest over Spark DataFrames.

Items and collections are plain DataFrames; every operator takes and returns
DataFrames or Columns, so Catalyst sees the whole plan.
"""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
