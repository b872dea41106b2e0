"""Ordered windows and greedy scans.

Scans whose next step depends on what was accepted before run over one session or component at a time, which no
interaction crosses, so what is held is bounded by the data's own gaps; rows are sorted by a total key.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .ranges import sessions


class Tracks:
    """Closed intervals in lanes of disjoint ones, each sorted, so that those which meet an interval are found by bisection."""

    def __init__(self) -> None:
        self.lanes: list[tuple[list, list, list]] = []
        self.turned: list[tuple] = []  # start after end: looked through one by one

    def meet(self, start, end) -> list[int]:
        """The numbers of the intervals with a start up to end and an end from start on, rising."""
        found = [k for s, e, k in self.turned if s <= end and e >= start]
        for starts, ends, numbers in self.lanes:
            lo, hi = bisect.bisect_left(ends, start), bisect.bisect_right(starts, end)
            if lo < hi:
                found += numbers[lo:hi]
        return sorted(found)

    def add(self, start, end, number: int) -> None:
        if start > end:
            self.turned.append((start, end, number))
            return
        for starts, ends, numbers in self.lanes:
            at = bisect.bisect_left(ends, start)
            if at >= bisect.bisect_right(starts, end):
                break
        else:
            self.lanes.append(([], [], []))
            (starts, ends, numbers), at = self.lanes[-1], 0
        starts.insert(at, start)
        ends.insert(at, end)
        numbers.insert(at, number)


def per_session(df: DataFrame, by: Sequence[str], start: str, end: str, gap: int, order: Sequence, use: Sequence[str], scan: Callable[..., list], name: str, kind: pa.DataType) -> DataFrame:
    """df with a column that scan gives: it gets the columns in use of one session as lists, sorted by order.

    Sessions are intervals at most gap apart. Rows are dealt by session and sorted by Spark, which spills; a task then
    reads them as a stream and holds one session at a time, so many small sessions cost no more than their rows.
    """
    cut = sessions(df, by, start, gap, end)
    keys = [*by, "session"]
    dealt = cut.repartition(*keys).sortWithinPartitions(*keys, *order)

    def told(t: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
        lists = [t.column(c).to_pylist() for c in use]
        values: list = []
        for a, b in zip(bounds, bounds[1:]):
            values += scan(*[x[a:b] for x in lists])
        out = t.drop_columns(["session"]).append_column(name, pa.array(values, kind))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # parts of a session that may go on, each looked at once
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            ids = list(zip(*[b.column(c).to_pylist() for c in keys]))
            bounds = [k for k in range(len(ids)) if ids[k] != (ids[k - 1] if k else last)]
            last = ids[-1]
            if not bounds:
                held.append(b)
                continue
            if held or bounds[0]:
                t = pa.Table.from_batches([*held, b.slice(0, bounds[0])])
                yield from told(t, [0, t.num_rows])
            if len(bounds) > 1:
                t = pa.Table.from_batches([b.slice(bounds[0], bounds[-1] - bounds[0])])
                yield from told(t, [k - bounds[0] for k in bounds])
            held = [b.slice(bounds[-1])]
        if held:
            t = pa.Table.from_batches(held)
            yield from told(t, [0, t.num_rows])

    more = StructField(name, {pa.bool_(): BooleanType(), pa.int64(): LongType()}[kind], False)
    return dealt.mapInArrow(run, StructType([*df.schema.fields, more]))


def accept_by_capacity(df: DataFrame, by: Sequence[str], start: str, end: str, score: str, tie: Sequence[str], capacity: int | str = 2) -> DataFrame:
    """df with accepted: by falling score, a row is taken while no point of its closed interval is in capacity others.

    capacity: a number, or a column that gives each row's own.
    """

    def scan(starts: list, ends: list, caps: list) -> list[bool]:
        taken: list[tuple] = []
        told = []
        for s, e, cap in zip(starts, ends, caps if isinstance(capacity, str) else [capacity] * len(starts)):
            over = [(max(s, a), min(e, b)) for a, b in taken if a <= e and b >= s]
            edges = sorted([(a, 0) for a, _ in over] + [(b, 1) for _, b in over])
            depth = most = 0
            for _, closing in edges:
                depth += -1 if closing else 1
                most = max(most, depth)
            told.append(most < cap)
            if told[-1]:
                taken.append((s, e))
        return told

    use = [start, end, capacity if isinstance(capacity, str) else start]
    return per_session(df, by, start, end, 0, [F.desc(score), *tie], use, scan, "accepted", pa.bool_())


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence, scan: Callable[[list[dict]], list[dict]], schema: str | StructType) -> DataFrame:
    """The rows that scan makes of each group: it gets the rows of one key, in order, as dictionaries and gives dictionaries.

    Rows are dealt by key and sorted by Spark, which spills; a task then reads them as a stream and holds one group at a
    time, so many small groups cost no more than their rows.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and any(row[k] != held[0][k] for k in keys):
                    out += scan(held)
                    held = []
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out = []
                held.append(row)
        if held:
            out += scan(held)
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, wanted)


def greedy_pairs(pairs: DataFrame, component: Sequence[str], a: str, b: str, cost: str, capacity_a: int = 1, capacity_b: int = 1, descending: bool = False) -> DataFrame:
    """pairs with accepted: in order of cost (then a, b) a pair is taken while both of its members have room.

    component: columns within which members occur, such as a connected component of the pairs (graph.greedy_matching finds
    these itself). cost can be a struct, which is compared field by field.
    """

    def scan(rows: list[dict]) -> list[dict]:
        left: dict = {}
        right: dict = {}
        for r in rows:
            x, y = r[a], r[b]
            r["accepted"] = left.get(x, 0) < capacity_a and right.get(y, 0) < capacity_b
            if r["accepted"]:
                left[x], right[y] = left.get(x, 0) + 1, right.get(y, 0) + 1
        return rows

    schema = StructType([*pairs.schema.fields, StructField("accepted", BooleanType(), False)])
    return per_group(pairs, component, [F.desc(cost) if descending else F.col(cost), a, b], scan, schema)


def anchored_chains(df: DataFrame, by: Sequence[str], at: str, reach: int, tie: Sequence[str] = ()) -> DataFrame:
    """df with chain: a row joins the chain while it lies within reach of the chain's first row, else it starts one.

    A chain is named by its first row's place. Unlike a session it is bounded by its anchor, so it is scanned within
    sessions of gap reach.
    """

    def scan(places: list) -> list:
        out: list = []
        for x in places:
            out.append(x if not out or x - out[-1] > reach else out[-1])
        return out

    return per_session(df, by, at, at, reach, [at, *tie], [at], scan, "chain", pa.int64())


def max_sum_window(df: DataFrame, by: Sequence[str], at: str, value: str, width: int, tie: Sequence[str] = ()) -> DataFrame:
    """Per key the window (at - width, at] by range with the largest sum: its end and sum; ties to the earliest."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-width, 0)
    summed = df.select(*by, at, F.sum(value).over(w).alias("window_sum"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("window_sum"), at, *tie))
    return summed.withColumn("_r", best).where("_r = 1").select(*by, F.col(at).alias("window_end"), "window_sum")


def deepest_point(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Per key the smallest point that the most closed intervals share, and their number (no chaining)."""
    edges = df.select(*by, F.col(start).alias("pos"), F.lit(1).alias("d"), F.lit(0).alias("o")).union(df.select(*by, F.col(end), F.lit(-1), F.lit(1)))
    w = Window.partitionBy(*by).orderBy("pos", "o").rowsBetween(Window.unboundedPreceding, 0)
    depth = edges.select(*by, "pos", F.sum("d").over(w).alias("depth"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("depth"), "pos"))
    return depth.withColumn("_r", best).where("_r = 1").select(*by, "pos", F.col("depth").cast("long").alias("depth"))


def insert_while_querying(df: DataFrame, by: Sequence[str], start: str, end: str, order: Sequence[str]) -> DataFrame:
    """df with blocked_by: how many rows accepted before it, in order, its closed interval meets; accepted are those with none."""

    def scan(lows: list, highs: list) -> list[int]:
        # Accepted intervals are disjoint, so their starts and ends have one order.
        starts: list = []
        ends: list = []
        out = []
        for s, e in zip(lows, highs):
            lo, hi = bisect.bisect_left(ends, s), bisect.bisect_right(starts, e)
            out.append(max(0, hi - lo))
            if not out[-1]:
                starts.insert(lo, s)
                ends.insert(lo, e)
        return out

    return per_session(df, by, start, end, 0, order, [start, end], scan, "blocked_by", pa.int64())


def ranked(df: DataFrame, by: Sequence[str], order: Sequence, k: int = 1, name: str | None = None) -> DataFrame:
    """The first k rows of each key in order, with their rank if a name is given."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = df.withColumn("_rank", r).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", name) if name else out.drop("_rank")


def row_index(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """df with index, from 0 within each key."""
    return df.withColumn("index", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
