"""framewise: molecular-trajectory, sampling-statistics and corpus analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions that run inside tasks are shipped with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
