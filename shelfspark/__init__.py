"""Product exports cleaned, linked, indexed, searched and compared as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to executors by value, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
