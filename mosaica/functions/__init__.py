"""Distances, row algebra, norms and encoders."""
