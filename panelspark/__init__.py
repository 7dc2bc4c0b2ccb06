"""panelspark: audited features and anomalies for panel tables, as Spark plans.

A panel table has an entity, a category, an integer period and measures.  Every
operator maps DataFrames to DataFrames and takes column names as arguments.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
