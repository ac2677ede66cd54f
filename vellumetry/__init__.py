"""Document-quality analytics and training-data preparation on Spark DataFrames.

The package registers itself to be pickled by value, so that Python functions
reach executors that have no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
