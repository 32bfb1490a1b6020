"""tessella: market-risk and time-series analytics on Spark DataFrames."""
