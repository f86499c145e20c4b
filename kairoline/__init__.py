"""Analytics for time-based media data, built on PySpark DataFrames."""
