"""Types for Python functions, built without a running session so that workers can import the modules."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

SIMPLE: dict[str, DataType] = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType(), "bool": BooleanType()}


def struct(fields: str) -> StructType:
    """"name type, name type" as a struct."""
    return StructType([StructField(n, SIMPLE[t]) for n, t in (x.split() for x in fields.split(", "))])
