"""cathodyne: analytics on Spark DataFrames."""
