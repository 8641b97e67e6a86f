"""Web-corpus curation on Spark DataFrames."""
