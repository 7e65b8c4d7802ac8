"""Operators for preparing large text corpora.

Every module holds one operator with a general interface; ``queries`` registers
one query per operator over its whole table and ``corpus_pipeline`` (at the
repository top) chains five of them. Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
