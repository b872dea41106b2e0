"""Connected components on tables of any size; clique cover and agglomeration within bounded sessions."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Scratch
from .ordered import greedy_pairs, per_session


def checksum(edges: DataFrame) -> tuple:
    """Count and order-free sum of the rows, to see whether a round changed anything."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    edges: columns u, v of one ordered type; loops, repeats and either direction are allowed. Alternates a large-star and
    a small-star step, each one aggregation and one join, and writes the edges after each round. Every table that a join
    reads comes from storage, so both sides are shuffled for the join and adaptive execution can split a hub's rows.
    """
    flat = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = scratch.table(flat.distinct(), "edges")
    before = checksum(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = scratch.table(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        scratch.drop(low)
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        met = large.join(low, "u")
        pairs = met.select("u", F.col("m").alias("v")).union(met.select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = scratch.table(pairs.where("u <> v").distinct(), "small")
        scratch.drop(low, large, e)
        e, after = small, checksum(small)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def greedy_matching(pairs: DataFrame, by: Sequence[str], a: str, b: str, cost: str, capacity_a: int = 1, capacity_b: int = 1, descending: bool = False) -> DataFrame:
    """ordered.greedy_pairs within connected components of the pairs, so that a task holds no more than what interacts.

    by: columns, such as a contig, within which ids of members hold. Members are told apart by 64-bit hashes, for the
    components only: two that meet by chance make one component of two, with the same result.
    """
    scratch = Scratch(pairs.sparkSession, "matching")
    kept = scratch.table(pairs.withColumns({"_u": F.xxhash64(F.lit("a"), *by, a), "_v": F.xxhash64(F.lit("b"), *by, b)}), "pairs")
    found = connected_components(kept.select(F.col("_u").alias("u"), F.col("_v").alias("v")), scratch)
    placed = kept.join(found.select(F.col("node").alias("_u"), F.col("component").alias("_component")), "_u").drop("_u", "_v")
    return greedy_pairs(placed, ["_component"], a, b, cost, capacity_a, capacity_b, descending).drop("_component")


class UnionFind:
    """Disjoint sets of 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        root = i
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[i] != root:
            self.parent[i], i = root, self.parent[i]
        return root

    def merge(self, a: int, b: int) -> int:
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a
        return a


def greedy_cliques(n: int, linked: Callable[[int, int], bool], neighbours: list[list[int]]) -> list[list[int]]:
    """A small cover of 0..n-1 by cliques.

    Nodes by falling number of neighbours (then falling index) join the largest adjacent clique that they fit whole, seen
    through the node that started it, or start one; then members of small cliques move to larger ones that they fit.
    """
    order = sorted(range(n), key=lambda i: (len(neighbours[i]), i), reverse=True)
    cliques: list[list[int]] = []
    started: dict[int, int] = {}
    fits = lambda members, i: all(linked(i, m) for m in members if m != i)
    for i in order:
        near = sorted((j for j in neighbours[i] if j in started), key=lambda j: (len(cliques[started[j]]), j), reverse=True)
        home = next((started[j] for j in near if fits(cliques[started[j]], i)), None)
        if home is None:
            started[i] = len(cliques)
            cliques.append([i])
        else:
            cliques[home].append(i)
    by_size = sorted(range(len(cliques)), key=lambda k: (len(cliques[k]), k))
    for a, k in enumerate(by_size):
        for i in list(cliques[k]):
            to = next((h for h in reversed(by_size[a + 1 :]) if fits(cliques[h], i)), None)
            if to is not None:
                cliques[k].remove(i)
                cliques[to].append(i)
    return [c for c in cliques if c]


def clique_cover(df: DataFrame, by: Sequence[str], at: str, gap: int, compatible: Callable[[dict, dict], bool], tie: Sequence[str]) -> DataFrame:
    """df with clique, numbered within its session: rows within gap of each other that are compatible in pairs.

    compatible gets two rows as dictionaries; it is only asked for rows at most gap apart.
    """

    names = df.columns

    def scan(*columns: list) -> list[int]:
        rows = [dict(zip(names, r)) for r in zip(*columns)]
        place = [r[at] for r in rows]
        near: list[list[int]] = [[] for _ in rows]
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                if place[j] - place[i] > gap:
                    break
                if compatible(rows[i], rows[j]):
                    near[i].append(j)
                    near[j].append(i)
        sets = [set(x) for x in near]
        number = [0] * len(rows)
        for k, members in enumerate(sorted(map(sorted, greedy_cliques(len(rows), lambda a, b: b in sets[a], near)))):
            for i in members:
                number[i] = k
        return number

    return per_session(df, by, at, at, gap, [at, *tie], names, scan, "clique", pa.int64())


def agglomerate_anchors(anchors: list[tuple[int, int, int, int]], reach: int, most: int) -> list[int]:
    """Cluster of each two-anchor interval (left start, left end, right start, right end), -1 where it is discarded.

    Pairs merge by the smallest larger span of the two joined anchors, as long as both spans stay within reach. An item
    with more than ``most`` partners is taken for an abnormal region and discarded with all of them.
    """
    order = sorted(range(len(anchors)), key=lambda i: anchors[i])
    sets = UnionFind(len(anchors))
    box: dict[int, tuple] = {}
    last = None
    for k in order:
        if last is not None and anchors[k] == anchors[last]:
            sets.merge(last, k)
        else:
            last = k
    for k in order:
        box[sets.find(k)] = anchors[k]
    join = lambda p, q: (min(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), max(p[3], q[3]))
    span = lambda p: max(p[1] - p[0], p[3] - p[2])
    roots = sorted(box, key=lambda r: (box[r], r))
    dead, heap = set(), []
    for a, i in enumerate(roots):
        if i in dead:
            continue
        found = []
        for j in roots[a + 1 :]:
            if box[j][0] - box[i][0] > reach:
                break
            if j not in dead and span(join(box[i], box[j])) <= reach:
                found.append((span(join(box[i], box[j])), box[i], box[j], i, j))
        if len(found) > most:
            dead.update([i, *(f[4] for f in found)])
        else:
            heap += found
    heapq.heapify(heap)
    while heap:
        _, bi, bj, i, j = heapq.heappop(heap)
        if i in dead or j in dead or box.get(i) != bi or box.get(j) != bj:
            continue
        merged = join(bi, bj)
        root = sets.merge(i, j)
        del box[i], box[j]
        for k, b in box.items():
            if k not in dead and b[0] <= merged[1] + reach and b[1] >= merged[0] - reach and span(join(merged, b)) <= reach:
                heapq.heappush(heap, (span(join(merged, b)), merged, b, root, k))
        box[root] = merged
    return [-1 if sets.find(i) in dead else sets.find(i) for i in range(len(anchors))]


def agglomerate(df: DataFrame, by: Sequence[str], left: tuple[str, str], right: tuple[str, str], reach: int, most: int, tie: Sequence[str]) -> DataFrame:
    """df with cluster, numbered within its session of left anchors at most reach apart; -1: discarded."""

    def scan(*columns: list) -> list[int]:
        return agglomerate_anchors(list(zip(*columns)), reach, most)

    return per_session(df, by, left[0], left[1], reach, [*left, *right, *tie], [*left, *right], scan, "cluster", pa.int64())
