"""Content-security analytics on Spark DataFrames."""
