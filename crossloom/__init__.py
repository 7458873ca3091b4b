"""crossloom: factor analytics over date x instrument panels, as Spark DataFrames."""
