"""echoline: a Spark-first analytics engine for acoustic sensor networks.

Relational work is declared with DataFrames and SQL so that Catalyst plans it;
array mathematics that SQL cannot express runs in Arrow-batched functions.
Functions that run on executors are pickled by value, so that a cluster needs
no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
