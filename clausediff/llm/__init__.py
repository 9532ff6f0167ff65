"""Operators for large-scale training-data preparation, as Spark jobs."""
