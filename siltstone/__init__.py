"""siltstone: ranked retrieval, its evaluation, and corpus preparation on Spark DataFrames."""
