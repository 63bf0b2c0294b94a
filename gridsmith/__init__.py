"""Tabular exploration, cleaning, modelling and evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Pandas functions travel to the executors by value, so a cluster needs no
# install of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
