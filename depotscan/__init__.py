"""Software-inventory analysis on Spark DataFrames."""
