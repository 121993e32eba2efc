"""Readers, writers and staged intermediate tables."""
