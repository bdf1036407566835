"""Tessera: composition analytics on Spark DataFrames."""
