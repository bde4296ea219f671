"""Composed pipelines over the operators."""
