"""Leafline: document-data analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
