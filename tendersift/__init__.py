"""Contract-transaction analytics on Spark DataFrames."""
