"""DataFrame -> DataFrame operators. No I/O, no clock: ``as_of`` and ``seed``
are always arguments.

Their task functions travel to the executors by value, so these need no copy of
the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
