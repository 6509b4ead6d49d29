"""News-analytics and text-data operators expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
