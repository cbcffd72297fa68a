"""paramloom: parameter sweeps and run-log analytics as Spark jobs.

Sub-packages
    functions   column expressions (Column -> Column)
    operators   DataFrame -> DataFrame operators
    sources     readers and writers
    streaming   the same log operators on Structured Streaming
    plans       the registered queries and the input recipes they share
"""

import sys

from pyspark import cloudpickle

# Functions run on executors travel with the job, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
