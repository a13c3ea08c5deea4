"""Corpus analytics on Spark: boolean search, text mining, topics, retrieval and answer statistics."""
