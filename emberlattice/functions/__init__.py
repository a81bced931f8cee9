"""Spark operators, see the modules."""
