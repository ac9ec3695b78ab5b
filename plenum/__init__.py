"""plenum: analytics over meeting transcripts and civic reference tables, on Spark DataFrames."""
