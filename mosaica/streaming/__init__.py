"""Streams of rows through fitted models."""
