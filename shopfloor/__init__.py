"""shopfloor: a retail sales warehouse on Spark DataFrames, SQL and Structured Streaming."""

__version__ = "0.1.0"
