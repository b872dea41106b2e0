"""Depth of intervals: per position as steps, per fixed window, per region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import range_join


def _pieces(df: DataFrame, by: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """Half-open intervals cut at multiples of width, with their window; a window is then complete by itself."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    cut = df.where(s < e).select(*by, s.alias("_s"), e.alias("_e"), F.explode(F.sequence(F.floor(s / width), F.floor((e - 1) / width))).alias("window"))
    lo = F.col("window") * width
    return cut.select(*by, "window", F.greatest("_s", lo).alias("_s"), F.least("_e", lo + width).alias("_e"))


def depth_steps(df: DataFrame, by: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """by, window, pos, depth: the depth from pos on, at each change within a window of width.

    Cutting intervals at windows lets every window be swept alone, so one long key is spread over its windows.
    """
    p = _pieces(df, by, start, end, width)
    edges = p.select(*by, "window", F.col("_s").alias("pos"), F.lit(1).alias("d")).union(p.select(*by, "window", F.col("_e").alias("pos"), F.lit(-1).alias("d")))
    change = edges.groupBy(*by, "window", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by, "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return change.select(*by, "window", "pos", F.sum("d").over(w).cast("long").alias("depth"))


def window_max_depth(df: DataFrame, by: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """by, window, max_depth for every window that an interval touches; intervals are half-open."""
    return depth_steps(df, by, start, end, width).groupBy(*by, "window").agg(F.max("depth").alias("max_depth"))


def median_depth(df: DataFrame, by: Sequence[str], start: str, end: str, regions: DataFrame, key: str, r: tuple[str, str], width: int = 1000) -> DataFrame:
    """For each region (by, key, half-open r): the element n // 2 of the sorted depths of its positions.

    Depth counts intervals over a position. Positions aren't listed: intervals are cut at their region, a sweep gives the
    length of each depth, and the median is where half of the region's length is reached.
    """
    region = regions.select(*by, key, F.col(r[0]).cast("long").alias("_lo"), F.col(r[1]).cast("long").alias("_hi")).where("_lo < _hi")
    items = df.select(*by, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e")).where("_s < _e")
    met = range_join(region.withColumn("_last", F.col("_hi") - 1), items.withColumn("_stop", F.col("_e") - 1), by, ("_lo", "_last"), ("_s", "_stop"), width)
    edge = lambda pos, d: F.struct(pos.alias("pos"), F.lit(d).alias("d"))
    cut = met.select(*by, key, F.explode(F.array(edge(F.greatest("_s", "_lo"), 1), edge(F.least("_e", "_hi"), -1))).alias("x"))
    ends = region.select(*by, key, F.explode(F.array(edge(F.col("_lo"), 0), edge(F.col("_hi"), 0))).alias("x"))
    change = cut.unionByName(ends).groupBy(*by, key, "x.pos").agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(*by, key).orderBy("pos")
    steps = change.select(*by, key, F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), (F.lead("pos").over(w) - F.col("pos")).alias("n")).where("n > 0")
    sizes = steps.groupBy(*by, key, "depth").agg(F.sum("n").alias("n"))
    p = Window.partitionBy(*by, key)
    told = sizes.withColumns({"_upto": F.sum("n").over(p.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(p)})
    return told.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by, key).agg(F.min("depth").cast("long").alias("median_depth"))
