"""Split-leakage auditing and corpus preparation on Spark DataFrames."""
