"""wakeline: trajectory-anomaly analytics on Spark DataFrames."""
