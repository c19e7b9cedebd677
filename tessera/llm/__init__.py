"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
registered queries and their oracle SQL. Functions of this subpackage that run
on executors travel with the plan, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
