"""Operators for building training corpora from very large document tables."""
