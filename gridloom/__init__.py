"""A Parquet-backed store for matrices and vectors of graph and vector indexes, on Spark DataFrames."""
