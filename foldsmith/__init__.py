"""Feature factory and two-stage classifier for wide tables, written on Spark DataFrames."""
