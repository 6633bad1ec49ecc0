"""Batch and streaming jobs over code-repository tables, and operators for training-data pipelines, on Spark DataFrames."""
