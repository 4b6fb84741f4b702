"""Spark jobs for star-cluster catalogues, and operators for text corpora."""
