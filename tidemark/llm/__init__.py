"""Operators for large-scale training-data pipelines (self-contained: nothing else in the package imports it)."""
