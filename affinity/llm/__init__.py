"""Operators of a training-data pipeline; nothing else in the library imports this package.

One module per operator, each with its own interface.  ``queries`` registers the
thin ``opN_<name>`` queries, ``corpus_pipeline.py`` at the repository top chains
five operators into a pipeline.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with their tasks, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
