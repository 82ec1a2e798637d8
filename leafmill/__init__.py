"""leafmill: paged-document analytics on Spark DataFrames."""
