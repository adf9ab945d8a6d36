"""HTTP-traffic analytics and scoring on Spark DataFrames."""
