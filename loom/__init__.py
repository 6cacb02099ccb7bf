"""loom: vector analytics, labelled-data operators and corpus operators on PySpark DataFrames."""
