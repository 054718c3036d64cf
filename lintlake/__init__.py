"""Source-quality and corpus analytics on Spark DataFrames."""
