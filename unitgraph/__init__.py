"""unitgraph: code-unit and call-graph analytics on Spark DataFrames."""
