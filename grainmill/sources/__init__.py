"""Readers, writers and raw-row transforms."""
