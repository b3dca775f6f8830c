"""Answer-engine visibility analytics on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Workers need not have the package installed: its few Python functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
