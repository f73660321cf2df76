"""Pointwise model functions."""
