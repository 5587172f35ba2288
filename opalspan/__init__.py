"""opalspan: sensitive-text analytics on Spark DataFrames."""
