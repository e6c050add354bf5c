"""Trust-tiered, bitemporal graph analytics over community text, on Spark DataFrames."""
