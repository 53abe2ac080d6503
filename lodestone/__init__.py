"""A full-text index and search engine on Spark DataFrames, with operators for preparing large collections."""
