"""Farm, land and market-price analytics on Spark DataFrames."""
