"""Training-data operators: ten corpus jobs over ``documents`` and ``embeddings``.

Nothing else in the library imports this package.  Functions that run inside
Python workers are pickled by value, so executors need numpy and pyarrow but
not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
