"""Document retrieval, enrichment and evaluation on Spark DataFrames."""
