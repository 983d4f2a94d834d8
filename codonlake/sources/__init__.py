"""Readers with explicit schemas; the feature store and report files."""
