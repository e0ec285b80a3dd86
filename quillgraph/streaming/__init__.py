"""Incremental insert from streams."""
