"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T and size S takes every document T / S times on average. The whole part is taken outright; the
fractions are rounded in pairs: two documents move mass between each other, counted in words so that the pair's expected
words stay what they were, at random in one of the two directions with odds that keep each document's expectation, until
one of them is integral. The other goes on to the next document. Groups of at most ``group`` documents are rounded alone;
the one document that each leaves over goes up a reduction tree until a source has one, which is rounded by itself. So a
source's taken words miss its target by less than one document.

Random draws depend on the seed and the document alone, and a group is read in a total order, so reruns agree.

Defined cases: a null text or one without a word has size 0 and is taken 0 words; a null source is a source of its own,
listed last; a null doc_id is drawn like any other value; equal rows are rounded apart, which of them is which is left
open; an empty table gives an empty mix. Totals by source are one row a source and are weighed on the driver; a source's
rows never are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, words

#: Up to so many sources their totals are broadcast (a few MB); more are joined by shuffle.
BROADCAST_SOURCES = 50_000
STATE = "doc_id long, source_id int, size long, whole long, p double, path long"


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight; none exceeds most times its size, and the excess is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        by = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if by * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = by * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def uniform(seed: int, *key: object) -> float:
    """A number in [0, 1) fixed by the key."""
    return int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest(), "big") / 2.0**64


def pivot(sizes: np.ndarray, p: np.ndarray, draw) -> np.ndarray:
    """Round fractions in order until at most one is left between 0 and 1. draw(i, j) gives a uniform number."""
    p, last = p.copy(), -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if last < 0:
            last = i
            continue
        a, b = sizes[last], sizes[i]
        # In words: up is what the first can gain and the second lose, down the other way.
        up, down = min((1 - p[last]) * a, p[i] * b), min(p[last] * a, (1 - p[i]) * b)
        gain = up if draw(last, i) * (up + down) < down else -down
        full, empty = ((1 - p[last]) * a, p[i] * b) if gain > 0 else ((1 - p[i]) * b, p[last] * a)
        first_ends, second_ends = (gain == full, gain == empty) if gain > 0 else (-gain == empty, -gain == full)
        p[last] = (1.0 if gain > 0 else 0.0) if first_ends else p[last] + gain / a
        p[i] = (0.0 if gain > 0 else 1.0) if second_ends else p[i] - gain / b
        last = next((k for k in (last, i) if 0 < p[k] < 1), -1)
    return p


def _round(seed: int, level: int):
    """One level of the tree: the fractions of a group, in a total order. Ids stay whole numbers or null."""

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by([("size", "descending"), ("path", "ascending"), ("doc_id", "ascending")])
        ids, paths = g.column("doc_id").to_pylist(), g.column("path").to_pylist()
        p = pivot(g.column("size").to_numpy().astype(float), g.column("p").to_numpy(), lambda i, j: uniform(seed, level, ids[i], paths[i], ids[j], paths[j]))
        return g.select([c.split()[0] for c in STATE.split(", ")]).set_column(4, "p", pa.array(p, pa.float64()))

    return run


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, group: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of docs (doc_id, text, source).

    Sources by code point (null last) get the weights in turn; they share ``share`` times all words.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    rows = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("h")), "sizes")
    # Sources are told apart by bytes, whatever collation the column has.
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    known = [(r["source"], i, int(s), float(t), t / s if s else 0.0, max(1, -(-r["n"] // group))) for i, (r, s, t) in enumerate(zip(totals, sizes, goal))]
    sources = spark.createDataFrame(known, "source string, source_id int, source_size long, target double, rate double, groups long")
    sources = F.broadcast(sources) if len(known) <= BROADCAST_SOURCES else sources
    part = F.col("rate") - F.floor("rate")
    state = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "source_id", "size", F.when(F.col("size") > 0, F.floor("rate")).otherwise(0).cast("long").alias("whole"), F.when(F.col("size") > 0, part).otherwise(0.0).alias("p"), F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.col("groups")).alias("path")
    )
    done, level, most_groups = [], 0, max((k[5] for k in known), default=1)
    while True:
        state = scratch.table(state.groupBy("source_id", F.col("path").alias("g")).applyInArrow(_round(seed, level), STATE), f"level{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(state.where(~open_))
        state = state.where(open_)
        if most_groups <= 1:
            break
        level, most_groups = level + 1, -(-most_groups // 64)
        state = state.withColumn("path", F.floor(F.col("path") / 64).cast("long"))
    # One document a source is left: by itself it is rounded to the nearer side of a draw, as its own expectation asks.
    key = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "source_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 13), 16, 10).cast("double")
    done.append(state.withColumn("p", F.when(key / float(16**13) < F.col("p"), 1.0).otherwise(0.0)))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    copies = F.col("whole") + F.col("p").cast("long")
    return whole.join(sources, "source_id").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; documents without a word go.

    Copies are found by (doc_id, source, size); rows that agree in all three share their copies out in a fixed order.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    key = {"_sl_id": F.col("doc_id").cast("long"), "_sl_size": F.size(words(F.col("text"))).cast("long")}
    mixed = mix(docs, scratch=scratch, **options).where("copies > 0")
    counts = mixed.groupBy(F.col("doc_id").alias("_sl_id"), F.col("size").alias("_sl_size"), F.col("source").alias("_sl_source")).agg(F.array_sort(F.collect_list("copies"), lambda a, b: (b - a).cast("int")).alias("_sl_copies"))
    counts = scratch.table(counts, "copies")
    same = Window.partitionBy("_sl_id", "_sl_size", "source").orderBy(F.xxhash64("text"))
    d = docs.withColumns(key)
    rows = d.join(counts, d["_sl_id"].eqNullSafe(counts["_sl_id"]) & (d["_sl_size"] == counts["_sl_size"]) & d["source"].eqNullSafe(counts["_sl_source"])).select(*docs.columns, d["_sl_id"], d["_sl_size"], "_sl_copies")
    nth = rows.withColumn("_sl_n", F.row_number().over(same))
    return nth.where(F.col("_sl_n") <= F.size("_sl_copies")).withColumn("_sl_again", F.explode(F.sequence(F.lit(1), F.element_at("_sl_copies", F.col("_sl_n")).cast("int")))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
