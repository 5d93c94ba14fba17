"""Readers, writers and projections into the library's tables."""
