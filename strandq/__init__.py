"""strandq: sequence, interval, statistics and text analytics on PySpark DataFrames."""
