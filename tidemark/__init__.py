"""tidemark: gridded time series, event studies and corpus preparation on PySpark."""
