"""Operators for large training-data pipelines over documents and embeddings.

Nothing else in the library imports this package. Its functions travel to the Python
workers by value, so a worker needs numpy, pandas and Arrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
