"""Multimodal clustering analytics on PySpark."""
