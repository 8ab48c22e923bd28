"""coordspark: labelled multi-dimensional analytics expressed as Spark DataFrames."""

from coordspark._ship import ship_with_closures

ship_with_closures(__name__)

__version__ = "0.1.0"
