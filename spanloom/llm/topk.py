"""Exact top-k search by columnar branch and bound.

Vectors are scaled to whole numbers and stored by dimension: a block holds one row of an array for each dimension. A query
adds up its inner products dimension block by dimension block. After each, what the rest can still add is bounded by the
product of the remaining masses (Cauchy-Schwarz over the dimensions not yet read), candidates whose bound falls short of
the query's tenth best score so far are dropped, and the survivors are compacted. Dimensions are read in an order of
falling mass, which is measured over all vectors.

Queries and candidates meet in groups of ``per_task`` blocks of at most ``block`` vectors each: every query group is sent to
every candidate group once, so a task holds so many blocks of each whatever the size of the table. One block of candidates
is searched for all queries first; the k-th best scores found there are where every task begins to prune.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id;
shorter vectors count as padded with zeros; rows with the query's own id are no candidates; repeated rows are queries of
their own and candidates of their own, so a query id that stands on two rows has two lists; ties go to the smaller id;
an empty table gives an empty result; scores beyond 64 bits end at its bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SCALE = 1024.0
LEAST, MOST = -(2**63), 2**63 - 1
HITS = "q_block long, q_row long, query_id long, vec_id long, score long"
BLOCK = "block long, ids binary, dims binary, n int"


def usable(x: Column) -> Column:
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return x.isNotNull() & F.coalesce(F.forall(x.cast("array<double>"), real), F.lit(False))


def _blocks(order: list[int], size: int):
    """Vertical blocks out of rows (vec_id, x): ids, and one row of doubles for each dimension in order.

    A block's number is that of its task and a running one, so that equal rows in two tasks stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n, first = len(order), 0, TaskContext.get().partitionId() << 32

        def made(ids: list, xs: list) -> pa.RecordBatch:
            m = np.zeros((d, len(ids)))
            for k, x in enumerate(xs):
                m[: len(x), k] = x
            nonlocal n
            n += 1
            cols = [pa.array([first + n], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(m[order]).tobytes()], pa.binary()), pa.array([len(ids)], pa.int32())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "dims", "n"])

        ids, xs = [], []
        for b in batches:
            for i, x in zip(b.column("vec_id").to_pylist(), b.column("x")):
                ids.append(i)
                xs.append(np.floor(x.values.to_numpy(zero_copy_only=False)))
                if len(ids) == size:
                    yield made(ids, xs)
                    ids, xs = [], []
        if ids:
            yield made(ids, xs)

    return run


def tail_mass(m: np.ndarray, step: int) -> np.ndarray:
    """For each start of a dimension block, the length of what lies from there on, a little rounded up."""
    sq = (m * m)[::-1].cumsum(axis=0)[::-1]
    return np.sqrt(sq[::step]) * (1 + 1e-9) + 1e-9


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, step: int, best: list[list], floors: np.ndarray | None = None) -> None:
    """Keep in best, for each query, its k highest (score, -id) of this and earlier candidate blocks.

    floors: for each query a score that k other vectors are known to reach, so that what falls short of it can go.
    """
    rest_q, rest_c = tail_mass(q, step), tail_mass(c, step)
    # Below 2**53 every partial sum is a whole number that a double holds; beyond, Python's whole numbers are used.
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * len(q) < 2.0**53
    for j, qid in enumerate(q_ids.tolist()):
        held = best[j]
        floor = max(held[-1][0] if len(held) >= k else -np.inf, -np.inf if floors is None else floors[j])
        alive = np.flatnonzero(c_ids != qid)
        if not exact:
            whole = [int(v) for v in q[:, j]]
            score = np.array([max(LEAST, min(MOST, sum(a * int(v) for a, v in zip(whole, c[:, i])))) for i in alive], np.int64)
        else:
            score = np.zeros(len(alive))
            for b in range(len(rest_q)):
                lo = b * step
                part = c[lo : lo + step] if len(alive) == c.shape[1] else c[lo : lo + step, alive]
                score = score + q[lo : lo + step, j] @ part
                if b + 1 < len(rest_q) and len(alive):
                    slack = rest_q[b + 1, j] * rest_c[b + 1, alive]
                    # What is sure by now: the k-th best of the lower bounds, or of the scores held.
                    sure = max(floor, np.partition(score - slack, len(alive) - k)[len(alive) - k]) if len(alive) > k else floor
                    kept = score + slack >= sure
                    if not kept.all():
                        alive, score = alive[kept], score[kept]
            score = score.astype(np.int64)
        best[j] = sorted(held + _first(score, c_ids[alive], k), reverse=True)[:k]


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k highest (score, -id)."""
    at = np.lexsort((ids, -score))[:k]
    return list(zip(score[at].tolist(), (-ids[at]).tolist()))


def _unpacked(r: dict, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["dims"]).reshape(d, r["n"])


def _floored(seed: dict, k: int, step: int, d: int):
    """Query blocks with each query's k-th best score among the vectors of one candidate block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_ids, c = _unpacked(seed, d)
        for b in batches:
            floors = []
            for r in b.to_pylist():
                q_ids, q = _unpacked(r, d)
                best: list[list] = [[] for _ in q_ids]
                search_block(q_ids, q, c_ids, c, k, step, best)
                floors.append(np.array([x[-1][0] if len(x) >= k else -np.inf for x in best], float).tobytes())
            yield b.append_column("floors", pa.array(floors, pa.binary()))

    return run


def _search(k: int, step: int, d: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows, blocks = [], [_unpacked(r, d) for r in candidates.to_pylist()]
        for r in queries.to_pylist():
            key, (q_ids, q), floors = r["block"], _unpacked(r, d), np.frombuffer(r["floors"])
            best = [[] for _ in q_ids]
            for c_ids, c in blocks:
                search_block(q_ids, q, c_ids, c, k, step, best, floors)
            rows += [(key, j, qid, -neg, s) for j, (qid, held) in enumerate(zip(q_ids.tolist(), best)) for s, neg in held]
        cols = zip(*rows) if rows else ((),) * 5
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["q_block", "q_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, query: Column, k: int = 10, step: int = 16, block: int = 2048, per_task: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) that meets query, its k best others."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * SCALE)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), query.alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    mass = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.abs("v")).alias("m")).collect()
    order = [r["i"] for r in sorted(mass, key=lambda r: (-r["m"], r["i"]))]
    width = max(1, len(order))
    candidates = scratch.table(rows.select("vec_id", "x").mapInArrow(_blocks(order, block), BLOCK), "candidates")
    queries = scratch.table(rows.where("is_query").select("vec_id", "x").mapInArrow(_blocks(order, block), BLOCK), "queries")
    # One block of candidates, bounded by its size, gives every task a bound to begin with.
    seed = candidates.orderBy(F.desc("n"), "block").first()
    if seed is not None:
        queries = scratch.table(queries.mapInArrow(_floored(seed.asDict(), k, step, width), f"{BLOCK}, floors binary"), "floored")
    else:
        queries = queries.withColumn("floors", F.lit(None).cast("binary"))
    groups, q_groups = (max(1, -(-t.count() // per_task)) for t in (candidates, queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("qg", every(q_groups))
    q = queries.withColumn("qg", F.pmod(F.xxhash64("block"), F.lit(q_groups)).cast("int")).withColumn("g", every(groups))
    hits = q.groupBy("g", "qg").cogroup(c.groupBy("g", "qg")).applyInArrow(_search(k, step, width), HITS)
    rank = F.row_number().over(Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best others of each vector whose vec_id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
