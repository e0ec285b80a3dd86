"""Graph-based retrieval over Spark DataFrames."""
