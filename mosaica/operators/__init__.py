"""Clustering operators and quality measures."""
