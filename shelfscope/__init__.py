"""shelfscope: catalogue, review and crawl analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the executors by value, so a job needs no package
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
