"""Hierarchical community retrieval over text, as Spark jobs."""
