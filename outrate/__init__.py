"""Rate-distortion outlier analytics on Spark DataFrames."""
