"""litmill: scholarly-metadata analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel with the plan, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
