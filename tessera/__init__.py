"""Tessera: triangle-mesh analytics on Spark DataFrames."""
