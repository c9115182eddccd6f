"""pairlift: variant-to-trait association analytics as Spark jobs.

Every public function takes DataFrames plus parameters and returns a DataFrame.
"""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
