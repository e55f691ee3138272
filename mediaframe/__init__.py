"""mediaframe: analytics over media-file metadata as Spark DataFrames."""
