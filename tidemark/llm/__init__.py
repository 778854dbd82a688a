"""Operators for preparing training text, each on Spark tables. Nothing else imports them.

Functions that run inside tasks are pickled by value, so executors need no copy of this
folder on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
