"""Spark operators for interval-shaped and evidence-shaped data."""
