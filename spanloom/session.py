"""A session with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "spanloom", **conf: str) -> SparkSession:
    """The active session, or a new one: UTC, adaptive execution, as many shuffle partitions as cores when local.

    Keyword arguments are Spark settings with dots as two underscores. A cluster's own settings stay as they are.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", "") and not os.environ.get("SPARK_MASTER"):
        cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
