"""Pattern memory over market-style time series, on Spark DataFrames."""
