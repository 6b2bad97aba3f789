"""testfloor: semiconductor test-data analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python tasks travel with the job, so that executors
# need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
