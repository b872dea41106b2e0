"""Range joins, interval merging and point sweeps as equi joins over bins.

Spark plans an overlap condition as a join on the equi keys with a residual filter, which is quadratic per key. Here every
interval is put in the bins it touches, both sides are joined on (keys, bin), and a pair is kept only in the later of the
two first bins, which both intervals touch: each pair comes out once, without a pass to remove repeats. A hot key is split
by its bins. Interval ends are inclusive unless said otherwise. Intervals with a null end or a start after the end meet
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Interval = tuple[str, str]


def _bin(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("long")


def binned(df: DataFrame, at: Interval, width: int, bin_name: str, first_name: str) -> DataFrame:
    """df with one row for each bin that [at] touches, and its first bin."""
    start, end = (F.col(c) for c in at)
    ok = start.isNotNull() & end.isNotNull() & (start <= end)
    return df.where(ok).withColumn(first_name, _bin(start, width)).withColumn(bin_name, F.explode(F.sequence(_bin(start, width), _bin(end, width))))


def range_join(left: DataFrame, right: DataFrame, on: Sequence[str], l: Interval, r: Interval, width: int, residual: Column | None = None) -> DataFrame:
    """All pairs with equal ``on`` whose intervals share a point: l.start <= r.end and l.end >= r.start.

    The column names of the two sides must differ but for ``on``. width: about the length of the longer intervals; a
    pair costs as many candidate rows as both sides have intervals in common bins.
    """
    a, b = binned(left, l, width, "_bin", "_first_l"), binned(right, r, width, "_bin", "_first_r")
    hit = (F.col(l[0]) <= F.col(r[1])) & (F.col(l[1]) >= F.col(r[0])) & (F.col("_bin") == F.greatest("_first_l", "_first_r"))
    out = a.join(b, [*on, "_bin"]).where(hit if residual is None else hit & residual)
    return out.drop("_bin", "_first_l", "_first_r")


def contains_join(left: DataFrame, right: DataFrame, on: Sequence[str], l: Interval, r: Interval, width: int, slack: int = 0) -> DataFrame:
    """Pairs where the right interval lies within the left one, widened by slack at both ends."""
    inside = (F.col(r[0]) >= F.col(l[0]) - slack) & (F.col(r[1]) <= F.col(l[1]) + slack)
    if not slack:
        return range_join(left, right, on, l, r, width, inside)
    wide = left.withColumns({"_lo": F.col(l[0]) - slack, "_hi": F.col(l[1]) + slack})
    return range_join(wide, right, on, ("_lo", "_hi"), r, width, inside).drop("_lo", "_hi")


def point_join(points: DataFrame, ranges: DataFrame, on: Sequence[str], at: str, r: Interval, width: int) -> DataFrame:
    """Points within ranges, ends included. A point has one bin, so only ranges are repeated."""
    a = points.where(F.col(at).isNotNull()).withColumn("_bin", _bin(F.col(at), width))
    b = binned(ranges, r, width, "_bin", "_first_r").drop("_first_r")
    return a.join(b, [*on, "_bin"]).where(F.col(at).between(F.col(r[0]), F.col(r[1]))).drop("_bin")


def overlap_semi(left: DataFrame, right: DataFrame, on: Sequence[str], l: Interval, r: Interval, width: int, key: Sequence[str], anti: bool = False, exactly: int | None = None) -> DataFrame:
    """Rows of left that meet some row of right, each once; anti: that meet none; exactly: (not) just so many.

    key names columns that tell left's rows apart. The hits are counted per key first, so right is never collected.
    """
    hits = range_join(left.select(*dict.fromkeys([*key, *on, *l])), right.select(*dict.fromkeys([*on, *r])), on, l, r, width)
    found = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    if exactly is not None:
        found = found.where(F.col("_n") == exactly)
    return left.join(found.drop("_n"), list(key), "left_anti" if anti else "left_semi")


def band_self_join(df: DataFrame, on: Sequence[str], at: str, gap: int, key: str, residual: Column | None = None) -> DataFrame:
    """Pairs (a, b) of rows with equal on, a.at <= b.at <= a.at + gap and a.key < b.key where at ties; as structs a and b."""
    s = F.struct(*[c for c in df.columns])
    a = df.select(*on, s.alias("a"), _bin(F.col(at), gap + 1).alias("_bin"))
    b = df.select(*on, s.alias("b"), F.explode(F.array(_bin(F.col(at), gap + 1), _bin(F.col(at), gap + 1) - 1)).alias("_bin"))
    x, y = F.col(f"a.{at}"), F.col(f"b.{at}")
    hit = (y - x).between(0, gap) & ((y > x) | (F.col(f"b.{key}") > F.col(f"a.{key}")))
    return a.join(b, [*on, "_bin"]).where(hit if residual is None else hit & residual).drop("_bin")


def merge_intervals(df: DataFrame, by: Sequence[str], at: Interval, slack: int = 0, touching: bool = True) -> DataFrame:
    """Islands of df's intervals per key: by, start, end, n (intervals in it).

    Two intervals belong together if the next start is at most slack beyond the largest end so far (touching) or less
    than that (not touching). Gaps and islands by one sort; the second of its windows reuses the first one's partitioning.
    """
    start, end = F.col(at[0]), F.col(at[1])
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) + slack
    new = reach.isNull() | ((start > reach) if touching else (start >= reach))
    marked = df.where(start.isNotNull() & end.isNotNull() & (start <= end)).withColumn("_new", new.cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def covered_length(df: DataFrame, by: Sequence[str], at: Interval) -> DataFrame:
    """Points under at least one half-open interval, per key."""
    return merge_intervals(df, by, at).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def sessions(df: DataFrame, by: Sequence[str], at: str, gap: int, end: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """df with session: rows whose start is within gap of the largest at (or end) before them share a number per key."""
    w = Window.partitionBy(*by).orderBy(at, *tie)
    reach = F.max(end or at).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flag = F.when(reach.isNull() | (F.col(at) - reach > gap), 1).otherwise(0)
    return df.withColumn("_new", flag).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")
