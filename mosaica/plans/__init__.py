"""Preparation of raw frames, and search for the best clustering of prepared ones."""
