"""Website-transparency measurement on Spark DataFrames."""
