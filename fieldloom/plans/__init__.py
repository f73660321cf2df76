"""Symbolic expressions, scheme binding and lowering to columns."""
