"""Knowledge-base and code-graph analytics on Spark DataFrames."""
