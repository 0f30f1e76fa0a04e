"""Batch and streaming Spark jobs over corpora of bilingual book text."""
