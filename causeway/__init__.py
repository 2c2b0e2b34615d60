"""Incident analytics as Spark DataFrame transformations.

Every function takes and returns DataFrames or Columns; ``investigation_id`` is a
key in every table, so one job serves all investigations at once.
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so the package need not
# be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
