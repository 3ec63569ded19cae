"""Operators for preparing training text at scale, and the pipeline's building blocks."""
