"""Alignment, fusion and insight over differently shaped datasets, declared as Spark plans."""

import sys

from pyspark import cloudpickle

#: Functions sent to executors carry their code, so that executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
