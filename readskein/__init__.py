"""Read clustering and table processing on Spark DataFrames."""
