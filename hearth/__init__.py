"""hearth: household segmentation as Spark DataFrame jobs.

Every operator is a plain function ``(DataFrame(s), params) -> DataFrame``.
Nothing row-scale is collected to the driver; the only driver-side values are
bounded by (columns x levels) or (k x features).
"""

import sys

from pyspark import cloudpickle

from hearth.session import get_session, checkpoint_dir

# functions of this package travel to Python workers by value, so that executors
# need not have the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "checkpoint_dir"]
