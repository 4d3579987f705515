"""Operators for preparing training corpora (language ID, near-dedup,
decontamination, mixing, sharding, ...).  Nothing else in the library
imports this subpackage; ``queries.py`` holds the registered queries."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
