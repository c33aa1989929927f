"""spanforge: a Spark-native engine for ordered event traces."""

from __future__ import annotations

import sys


def ship_code() -> None:
    """Send this package's Python functions to executors by value.

    Workers then need no installed copy of the package, wherever the driver imported it from.
    """
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


ship_code()
