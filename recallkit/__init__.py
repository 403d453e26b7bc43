"""A memory store and retrieval engine on Spark DataFrames."""
