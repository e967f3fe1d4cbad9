"""Operators for preparing training data: deduplication, decontamination, filtering, packing, formatting and search."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
