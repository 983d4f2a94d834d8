"""Fixtures, registered queries, whole runs and the command line."""
