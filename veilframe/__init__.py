"""veilframe: text-privacy analytics on Spark DataFrames."""
