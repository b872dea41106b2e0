"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR, DAY = 3_600_000_000, 86_400_000_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (UTC)."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def exact_sum(x: Column | str, kind: str = "decimal(18,2)") -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum((F.col(x) if isinstance(x, str) else x).cast(kind)).cast("double")
