"""Spark-first data engine for program-analysis output and training-data corpora."""
