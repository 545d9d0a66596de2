"""netloom: utility-network planning and analytics on Spark DataFrames."""
