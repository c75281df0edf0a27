"""Document and policy analytics on Spark DataFrames."""
