"""Which owner each item of evidence belongs to."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from ..functions.hashes import draw


def shared_owners(df: DataFrame, item: Sequence[str], score: str) -> DataFrame:
    """All rows that reach an item's highest score: ties own it together."""
    best = F.rank().over(Window.partitionBy(*item).orderBy(F.desc(score)))
    return df.withColumn("_rank", best).where("_rank = 1").drop("_rank")


def exclusive_owner(df: DataFrame, item: str, owner: str, score: str, quality: str, seed: int = 0, place: str | None = None, pass_quality: float = 0.05, least: int = 3) -> DataFrame:
    """item, owner: one owner for each item.

    Owners above pass_quality come before others, then the score decides. U is the number of items that an owner has
    alone at the top; fewer than ``least`` count as none. Among several owners the two first by (class, U, quality) are
    drawn with odds U1 : U2, by a hash of seed, place and item, so the same item is always drawn alike; a better class
    wins outright; without any U the higher quality wins, of equal ones the first.
    """
    ok = (F.col(quality) >= pass_quality).cast("int")
    tops = df.withColumn("_ok", ok).withColumn("_r", F.rank().over(Window.partitionBy(item).orderBy(F.desc("_ok"), F.desc(score)))).where("_r = 1")
    per = tops.groupBy(item, owner).agg(F.max("_ok").alias("_ok"), F.max(quality).alias("_q"), *([F.first(place).alias("_place")] if place else [F.lit("").alias("_place")]))
    n = per.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(item)))
    unique = n.where("_n = 1").groupBy(owner).agg(F.count(F.lit(1)).alias("_u"))
    known = n.join(unique, owner, "left").withColumn("_u", F.coalesce("_u", F.lit(0)))
    order = Window.partitionBy(item).orderBy(F.desc("_ok"), F.desc("_u"), F.desc("_q"), F.desc(owner))
    two = known.withColumn("_k", F.row_number().over(order)).where("_k <= 2")
    side = two.groupBy(item).agg(*[F.max(F.when(F.col("_k") == k, F.struct(F.col(owner).alias("o"), F.col("_ok").alias("ok"), F.when(F.col("_u") >= least, F.col("_u")).otherwise(0).alias("u"), F.col("_q").alias("q")))).alias(f"_{k}") for k in (1, 2)], F.first("_place").alias("_place"))
    total = F.col("_1.u") + F.col("_2.u")
    # Only items that need a draw go through Python, in Arrow batches.
    drawn = F.when(F.col("_2").isNotNull() & (F.col("_1.ok") == F.col("_2.ok")) & (total > 0), _draws(seed)(F.col("_place").cast("string"), F.col(item).cast("string"), total))
    second = (F.col("_2").isNotNull()) & (F.col("_1.ok") == F.col("_2.ok")) & F.when(total > 0, drawn > F.col("_1.u")).otherwise(F.col("_2.q") > F.col("_1.q"))
    return side.select(item, F.when(second, F.col("_2.o")).otherwise(F.col("_1.o")).alias(owner))


def _draws(seed: int):
    @F.pandas_udf(LongType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for place, item, total in batches:
            yield pd.Series([draw(seed, (p or "", i or ""), int(t)) if t and t > 0 else None for p, i, t in zip(place, item, total)], dtype="Int64")

    return run


def other_support(df: DataFrame, target: str, item: str, point: str, flag: str) -> DataFrame:
    """target, point, n, n_flagged: items counted once for each target and point, their flags joined by or."""
    once = df.groupBy(target, point, item).agg(F.max(F.col(flag).cast("int")).alias("_f"))
    return once.groupBy(target, point).agg(F.count(F.lit(1)).alias("n"), F.sum("_f").alias("n_flagged"))
