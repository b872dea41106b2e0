"""Streams of events: window counts, sessions, pairing, and sliding clusters with state.

Every function takes and returns a streaming (or static) DataFrame; the caller chooses source, sink, trigger and
checkpoint. Lateness bounds state: what is older than the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_max(events: DataFrame, by: str, at: str, value: str, width: str, late: str) -> DataFrame:
    """by, window_start, max, n per fixed window."""
    w = F.window(at, width)
    out = events.withWatermark(at, late).groupBy(by, w).agg(F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("window.start").alias("window_start"), "max", "n")


def gap_sessions(events: DataFrame, by: str, at: str, gap: str, late: str) -> DataFrame:
    """by, start, end, n of sessions: events less than gap apart."""
    out = events.withWatermark(at, late).groupBy(by, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("start"), F.max(at).alias("end"))
    return out.select(by, "start", "end", "n")


def paired(left: DataFrame, right: DataFrame, key: str, l_at: str, r_at: str, within: str, late: str) -> DataFrame:
    """Rows of both streams with one key at most ``within`` apart; state is kept that long only."""
    a, b = left.withWatermark(l_at, late), right.withWatermark(r_at, late)
    near = (F.col(r_at) >= F.col(l_at) - F.expr(f"interval {within}")) & (F.col(r_at) <= F.col(l_at) + F.expr(f"interval {within}"))
    return a.alias("l").join(b.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & near, "inner").select(F.col(f"l.{key}").alias(key), l_at, r_at)


def sliding_clusters(events: DataFrame, by: str, at: str, reach_s: int, late: str) -> DataFrame:
    """by, start, end, n: rows within reach_s seconds of the first row of their cluster; told when the watermark passes.

    The state of a key is its rows that are not yet told, which the watermark bounds.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held += [int(t.value // 1000) for t in pd.to_datetime(f[at], utc=True)]
        held.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        told, start = [], 0
        for k in range(1, len(held) + 1):
            if k == len(held) or held[k] - held[start] > reach_s * 1_000_000:
                # A cluster is over once no row that could still come would fall in it.
                if held[start] + reach_s * 1_000_000 >= mark:
                    break
                told.append((key[0], held[start], held[k - 1], k - start))
                start = k
        held = held[start:]
        if held:
            state.update((held,))
            due = max((held[0] // 1000) + reach_s * 1000 + 1, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(due)
        else:
            state.remove()
        yield pd.DataFrame(told, columns=[by, "start", "end", "n"])

    kind = events.schema[by].dataType.simpleString()
    out = events.withWatermark(at, late).select(by, at).groupBy(by)
    return out.applyInPandasWithState(run, f"{by} {kind}, start long, end long, n long", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
