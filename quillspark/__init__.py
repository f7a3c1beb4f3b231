"""Document-review analytics as Spark DataFrames."""
