"""Term-trend analytics over dated document corpora, on Spark DataFrames."""
