"""Phrase-reference analytics on Spark."""
