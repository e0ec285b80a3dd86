"""Whole insert and query plans."""
