"""Transaction alert analytics on Spark: cleaning, summaries, detectors, alerts, retrieval, drift and versions."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
