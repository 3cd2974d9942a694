"""Operators for training-data pipelines: text tables in, Spark frames out."""
