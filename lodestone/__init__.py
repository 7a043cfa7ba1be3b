"""Lodestone: document retrieval and CRM analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along: a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
