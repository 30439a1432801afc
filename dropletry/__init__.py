"""Spark-first analytics for pooled single-cell sequencing and for text corpora."""
