"""Spark jobs for a library's book recommendations and for text corpora."""
