"""Operators for preparing training data: one module for each, and `queries` with what is registered."""
