"""Operators for preparing training text, independent of the rest of the package.

Functions that run inside tasks are shipped with the job (pickled by value), so the
executors need Python's libraries but no copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
