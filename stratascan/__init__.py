"""Scan-deconvolution analytics on Spark DataFrames."""
