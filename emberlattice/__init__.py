"""Gridded heat analytics and corpus preparation as lazy Spark plans."""
