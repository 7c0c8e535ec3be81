"""lexweave: document analytics as Spark plans.

Functions that run on executors are pickled by value, so a cluster needs
PySpark and the Python libraries, not this package, on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
