"""Call-record analytics on Spark DataFrames.

Hourly call files are loaded into a partitioned Parquet store, rolled up by the
hour, matched against an IP watchlist and answered as grouped reports.
"""
