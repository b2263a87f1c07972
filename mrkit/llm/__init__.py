"""Operators for training data of language models. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions travel with the query, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
