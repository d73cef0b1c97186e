"""tabwise: table analytics as Spark jobs (cleaning, profiling, roles, contracts, charts, statistics, ML)."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
