"""Operators of a training-data pipeline over documents and web pages.

Nothing else in the library imports this subpackage. Its queries are in ``queries.py``,
their DuckDB SQL in ``oracle.py``.
"""

import sys

from pyspark import cloudpickle

# Python workers get these functions with the task: they need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
