"""Point-in-time market research on Spark: every operator is a function from DataFrames to a DataFrame."""
