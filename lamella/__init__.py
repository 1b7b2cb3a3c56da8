"""Lightweight column encodings on Spark DataFrames."""
