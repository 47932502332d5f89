"""Catalogue ingest, document assembly and document search on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no
# separate install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
