"""Domain-threat analytics on Spark DataFrames."""
