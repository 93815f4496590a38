"""sluice: sensitive-data flow analytics and corpus preparation on Spark DataFrames."""
