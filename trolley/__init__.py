"""Batch recommendation jobs on Spark: candidate retrieval, basket features, click prediction."""
