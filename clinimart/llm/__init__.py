"""Operators for preparing text corpora. Nothing else in the library imports them.

Functions that run inside tasks are sent by value, so executors need not have
this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
