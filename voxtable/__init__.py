"""Speech timeline analytics on Spark DataFrames."""
