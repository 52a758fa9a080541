"""Social-trend and competitor-gap analytics on Spark DataFrames."""
