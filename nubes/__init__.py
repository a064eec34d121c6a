"""Point-cloud analytics as Spark DataFrames."""
