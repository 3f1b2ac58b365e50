"""Incremental landing with file streams."""
