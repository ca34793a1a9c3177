"""Public-transport punctuality analytics on Spark DataFrames and Structured Streaming."""
