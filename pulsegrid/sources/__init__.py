"""Readers, writers and the adapter from the given tables."""
