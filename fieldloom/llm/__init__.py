"""Training-data operators: language mixture, tokenisation, dedup, quality, packing.

Nothing outside this subpackage imports it.  Its kernels are pickled by value so that executors need no copy of the
repository on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
