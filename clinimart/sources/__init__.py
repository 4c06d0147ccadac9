"""Readers, writers and the mapping of the sample tables."""
