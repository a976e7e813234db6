"""Spark-native analysis of network flows: assembly, features, models, policy, event log."""

import sys

from pyspark import cloudpickle

from flowsieve.options import Options

# Functions that run inside Python workers travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Options"]
