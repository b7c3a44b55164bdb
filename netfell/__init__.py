"""netfell: hub analysis of undirected networks by random node removal, on PySpark DataFrames."""
