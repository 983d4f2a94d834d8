"""The same features over streams."""
