"""Ownership-ledger and price-series analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with the job, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
