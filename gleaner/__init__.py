"""Gleaner: document-retrieval analytics as Spark jobs."""
