"""Declarative web-record extraction and extraction-quality monitoring on Spark DataFrames."""
