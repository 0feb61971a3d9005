"""traceframe: analytics over structured text and its configuration, on Spark DataFrames."""
