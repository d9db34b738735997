"""Spark-native toolkit for turning messy business tables into trustworthy answers."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
