"""Unions, duplicates and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(frames: Sequence[DataFrame], order: Sequence[str] = (), stream: str = "stream") -> DataFrame:
    """All rows of frames with the number of the frame they came from, sorted by order and then by that number."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn(stream, F.lit(k))
        out = f if out is None else out.unionByName(f)
    return out.orderBy(*order, stream) if order else out


def first_source(frames: Sequence[DataFrame], key: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The rows of frames, of equal keys the one from the first frame."""
    w = Window.partitionBy(*key).orderBy("_stream", *tie)
    return merged(frames, stream="_stream").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_stream")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """df; an error that names one of them if a key occurs twice."""
    found = duplicates(df, key).limit(1).collect()
    if found:
        raise ValueError(f"duplicate key: {found[0].asDict()}")
    return df


def at_most(df: DataFrame, key: Sequence[str], n: int, order: Sequence) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def keep_best(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    return at_most(df, key, 1, order)


def drop_beaten(df: DataFrame, pairs: DataFrame, id_: str, precise: Column, quality: str) -> DataFrame:
    """df without the loser of each matched pair (a, b): precise beats imprecise, then higher quality; ties keep both."""
    side = lambda n: df.select(F.col(id_).alias(n), precise.alias(f"{n}_p"), F.col(quality).alias(f"{n}_q"))
    met = pairs.where("a <> b").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    lost = F.when(F.col("a_p") != F.col("b_p"), F.when(F.col("a_p"), F.col("b")).otherwise(F.col("a"))).when(F.col("a_q") > F.col("b_q"), F.col("b")).when(F.col("b_q") > F.col("a_q"), F.col("a"))
    losers = met.select(lost.alias(id_)).where(F.col(id_).isNotNull()).distinct()
    return df.join(losers, id_, "left_anti")


def same_atoms(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same set."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def pivoted(df: DataFrame, by: Sequence[str], column: str, values: Sequence, *aggregates: Column) -> DataFrame:
    """One row a key and one column a value; the values are given, so no pass is spent on finding them."""
    return df.groupBy(*by).pivot(column, list(values)).agg(*aggregates)


def confusion(df: DataFrame, by: Sequence[str], truth: str, called: str) -> DataFrame:
    """tp, fp, fn, tn, recall, precision and F1 per key; null where a denominator is 0."""
    t, c = F.col(truth).cast("boolean"), F.col(called).cast("boolean")
    n = df.groupBy(*by).agg(F.count_if(t & c).alias("tp"), F.count_if(~t & c).alias("fp"), F.count_if(t & ~c).alias("fn"), F.count_if(~t & ~c).alias("tn"))
    return n.withColumns({"recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def by_size(size: Column, bounds: Sequence[int] = (1, 5, 15, 50, 200, 1000, 5000)) -> Column:
    """Label of the bin of a size: [a, b), the last open."""
    out = F.lit(f">={bounds[-1]}")
    for a, b in reversed(list(zip(bounds, bounds[1:]))):
        out = F.when(size < b, f"{a}-{b - 1}").otherwise(out)
    return F.when(size >= bounds[0], out)


def max_then_mean(df: DataFrame, group: Sequence[str], item: str, x: str) -> DataFrame:
    """Mean over a group's items of each item's largest x."""
    return df.groupBy(*group, item).agg(F.max(x).alias("_m")).groupBy(*group).agg(F.avg("_m").alias("mean_max"))


def top_tied(df: DataFrame, by: Sequence[str], x: str, names: str) -> DataFrame:
    """Per key the largest x and all names that reach it, sorted and joined by commas."""
    w = Window.partitionBy(*by).orderBy(F.desc(x))
    top = df.withColumn("_r", F.rank().over(w)).where("_r = 1")
    return top.groupBy(*by).agg(F.max(x).alias("top"), F.array_join(F.array_sort(F.collect_set(F.col(names).cast("string"))), ",").alias("names"))


def informative(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that have values, and more than one: a single aggregation."""
    stats = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    return [c for c in columns if stats[f"lo_{c}"] is not None and stats[f"lo_{c}"] != stats[f"hi_{c}"]]


def consensus_bases(df: DataFrame, by: Sequence[str], seq: str, qual: str, offset: str) -> DataFrame:
    """by, pos, base, depth, quality: at each position the base with the largest quality sum, then count, then letter.

    seq is a string, qual an array of its base qualities, offset the position of its first base.
    """
    base = df.select(*by, F.posexplode(F.arrays_zip(F.split(seq, "").alias("b"), F.col(qual).alias("q"))).alias("i", "x"), F.col(offset).alias("_o"))
    votes = base.where("x.b <> ''").groupBy(*by, (F.col("_o") + F.col("i")).alias("pos"), F.col("x.b").alias("base")).agg(F.sum("x.q").alias("_q"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by, "pos")
    ranked = votes.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("_q"), F.desc("_n"), "base")), "depth": F.sum("_n").over(w)})
    return ranked.where("_r = 1").select(*by, "pos", "base", "depth", F.col("_q").alias("quality"))


def junction_counts(reads: DataFrame, by: Sequence[str], seq: str, alt: str, ref: str) -> DataFrame:
    """Reads that hold the alternative junction, else the reference's, per key."""
    has_alt, has_ref = F.col(seq).contains(F.col(alt)), F.col(seq).contains(F.col(ref))
    return reads.groupBy(*by).agg(F.count_if(has_alt).alias("alt_reads"), F.count_if(~has_alt & has_ref).alias("ref_reads"))
