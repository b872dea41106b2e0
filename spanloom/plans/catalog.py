"""All queries of the package's own operators."""

from . import domain, relational, synthetic  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
