"""Operators for large-scale training-data pipelines (optional sub-package)."""
