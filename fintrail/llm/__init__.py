"""Operators for large-scale training-data pipelines over documents, pages and conversations."""
