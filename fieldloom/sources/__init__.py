"""Reading and making fields, and scratch tables."""
