"""Structured-grid field analytics on Spark."""
