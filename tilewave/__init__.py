"""Signal, block and packet analytics on Spark DataFrames."""
