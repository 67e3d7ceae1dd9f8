"""Declarative, incremental entity pipelines on Spark DataFrames."""
