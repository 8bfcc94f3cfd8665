"""Operators for training-data corpora: scoring, rules, joins, scans, tokens.

The functions that run in Python workers travel with the job (by value), so a
cluster needs this package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
