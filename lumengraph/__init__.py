"""Evidence-graph analytics and text processing as DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry the package's code with them: executors need no copy of it on disk.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
