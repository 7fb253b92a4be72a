"""Counterfactual reweighting of observational tables with Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few Arrow helpers that run inside tasks are shipped with the closure, so
# executors need no copy of this package on their Python path.
register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
