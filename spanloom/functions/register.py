"""The package's functions by name, for SQL: what a session's queries can call after ``register(spark)``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import align, hashes

#: Functions that SQL itself expresses; they are inlined, so Catalyst sees through them.
EXPRESSIONS = {
    "reverse_complement": ("s string", "string", "reverse(translate(s, 'ACGTNacgtn', 'TGCANtgcan'))"),
    "gc_share": ("s string", "double", "try_divide(length(regexp_replace(s, '[^GCgc]+', '')), length(regexp_replace(s, '[^ACGTacgt]+', '')))"),
    "is_homopolymer": ("s string", "boolean", r"s rlike '^(.)\\1*$'"),
    "overlap_length": ("a long, b long, c long, d long", "long", "greatest(least(b, d) - greatest(a, c), 0)"),
    "has_flag": ("flag int, bit int", "boolean", "(flag & bit) <> 0"),
    "phred_error": ("q double", "double", "pow(10, -q / 10)"),
    "strip_twin": ("id string", "string", "regexp_replace(id, '_DUP$', '')"),
}


def register(spark: SparkSession, prefix: str = "sl_") -> list[str]:
    """Make all functions temporary functions of the session; their names."""
    for name, (args, kind, body) in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {prefix}{name}({args}) returns {kind} return {body}")
    columns = {"edit_distance": align.edit_distance_column, "align": align.align_columns, "fnv1a64": hashes.fnv1a64_column}
    for name, f in columns.items():
        spark.udf.register(prefix + name, f)
    return [prefix + n for n in (*EXPRESSIONS, *columns)]
