"""Operators for training-data corpora: packing, deduplication, quality, sharding, search, tokens, personal data, archives."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this package with the job, so that it need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
