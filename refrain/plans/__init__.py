"""Whole query plans."""
