"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on one machine (tests), a temporary folder is set once.

    On a cluster it has to be set: executors would write to their own disks.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


#: Spark then deletes a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The most rows of a batch between Spark and Python.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables of one run of an operator, in a folder of its own.

    A table's shuffle files go once it is written: all that comes later reads the table.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, name: str = "t", batch: int | None = None) -> DataFrame:
        """df, written and read again; its path is in the attribute scratch_path. batch: most rows that go to Python at a time."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        conf = {CLEANUP: "true"}
        if batch:
            most = int(self.spark.conf.get(BATCH))
            conf[BATCH] = str(min(batch, most) if most > 0 else batch)
        before = {k: self.spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t.scratch_path)

    def close(self) -> None:
        """Delete all tables of this run; only once nothing reads them any more."""
        self.remove(self.root)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
