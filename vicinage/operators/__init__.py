"""Search, clustering and estimation on DataFrames."""
