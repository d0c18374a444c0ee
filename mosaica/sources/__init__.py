"""Readers, writers and generators of frames."""
