"""Text-risk analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Batch functions travel with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
