"""A vector-search and analytics engine on Spark DataFrames."""
