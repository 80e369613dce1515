"""gridloom: array algebra and analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors with their code, so that clusters
# need no installation of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
