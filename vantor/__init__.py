"""Vector search and similarity analytics on Spark DataFrames."""
