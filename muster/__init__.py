"""Contact and account list engine on Spark DataFrames."""
