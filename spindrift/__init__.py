"""Code navigation and reference graphs as Spark DataFrames."""
