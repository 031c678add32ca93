"""Action-sequence analytics on Spark DataFrames."""
