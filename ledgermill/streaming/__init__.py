"""Incremental form of the import."""
