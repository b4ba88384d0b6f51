"""Bit-feature classification and ensemble analytics on Spark DataFrames."""
