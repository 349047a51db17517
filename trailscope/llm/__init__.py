"""Corpus operators for training-data pipelines, one module per operator.

Nothing outside this subpackage imports it. Each module states its method, its
inputs and the result for null, empty, repeated and very long rows.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
