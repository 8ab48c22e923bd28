"""Send this package's functions to Python workers inside the closures that use them."""

import sys

from pyspark.cloudpickle import register_pickle_by_value


def ship_with_closures(package: str) -> None:
    """Workers then need no copy of the package on their own path."""
    register_pickle_by_value(sys.modules[package])
