"""Search, forest building, voting and evaluation over DataFrames."""
