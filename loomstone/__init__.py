"""loomstone: text-corpus preparation and analytics on Spark DataFrames."""
