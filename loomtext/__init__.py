"""Context analytics on Spark: segmentation, content identity, versions, search trees and run statistics.

Functions that run inside tasks travel with the task itself, so executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
