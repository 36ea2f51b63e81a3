"""docloom: document processing, hybrid retrieval and evaluation analytics on Spark DataFrames."""
