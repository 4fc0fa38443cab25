"""Passage retrieval, evaluation and corpus preparation as Spark DataFrame pipelines."""
