"""Readers and create-only writers."""
