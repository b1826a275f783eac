"""Operators for training-data pipelines over documents, vectors and token files."""
