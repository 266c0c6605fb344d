"""Data operators built on Spark DataFrames and Structured Streaming."""
