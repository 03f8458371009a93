"""Analytics over aerial-survey embeddings and their tile statistics, as Spark DataFrames."""
