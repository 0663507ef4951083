"""Fund positions, trades and question-answering contexts as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to Spark travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
