"""Relational kernels with table-agnostic signatures: columns are passed by name."""
