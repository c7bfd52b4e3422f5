"""ballot: exact and learned nearest-neighbour search on Spark DataFrames."""

__version__ = "0.1.0"
