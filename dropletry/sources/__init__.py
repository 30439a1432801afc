"""Readers and writers of the text formats of sequencing, on Spark's text source and sink."""
