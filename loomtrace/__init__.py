"""Spark-native analytics for sequence features, reasoning traces and their audit.

Functions that run on executors travel with the job, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
