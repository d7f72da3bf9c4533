"""Analytics over print documents, and text pipelines, on Spark DataFrames."""
