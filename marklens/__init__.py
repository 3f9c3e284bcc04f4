"""marklens: asset-mark analytics and text-corpus jobs on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel with the job, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
