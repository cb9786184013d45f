"""weftline: hybrid-retrieval analytics on Spark DataFrames."""
