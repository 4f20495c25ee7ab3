"""blockloom: spatial-graph analytics and corpus preparation on Spark DataFrames."""
