"""Operators of a training-data pipeline (see README, section "llm").

Nothing else in the library imports this subpackage; ``catalog`` holds the
registered queries.  Operators are functions from DataFrames to DataFrames.
Functions of this subpackage are pickled by value, so executors need not be
able to import it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
