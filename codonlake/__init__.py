"""Sequence-feature analytics on Spark."""
