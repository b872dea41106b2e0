"""Column expressions, and Python functions for what they can't say."""
