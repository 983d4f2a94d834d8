"""Genetic code, sequence expressions, feature groups and metrics."""
