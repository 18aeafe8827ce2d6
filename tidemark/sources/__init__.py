"""Readers, writers and the table lenses."""
