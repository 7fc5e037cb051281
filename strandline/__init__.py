"""Ecological-boundary analytics on Spark."""
