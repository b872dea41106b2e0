"""Counts of what a range join would list, without listing it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Below:
    """Counts of values under a bound within ranges of places, for many ranges at once (a wavelet matrix)."""

    def __init__(self, values: np.ndarray):
        self.sorted = np.sort(values)
        rank = np.searchsorted(self.sorted, values)
        self.levels = []
        for b in range(len(values).bit_length() - 1, -1, -1):
            zero = (rank >> b) & 1 == 0
            before = np.concatenate(([0], np.cumsum(zero)))
            self.levels.append((b, before, before[-1]))
            rank = np.concatenate((rank[zero], rank[~zero]))

    def count(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray, equal: bool = False) -> np.ndarray:
        """How many values at places lo to hi - 1 are less than bound (equal: or equal); 0 where hi <= lo."""
        top = np.searchsorted(self.sorted, bound, "right" if equal else "left")
        lo, hi = np.broadcast_arrays(lo, np.maximum(lo, hi))
        n = np.zeros(len(top), np.int64)
        for b, before, zeros in self.levels:
            one = (top >> b) & 1 == 1
            a, z = before[lo], before[hi]
            n += np.where(one, z - a, 0)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - z, z)
        return n


class Spans:
    """Intervals by start, for counts by conditions on both ends."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        order = np.argsort(lo, kind="stable")
        self.lo, self.hi = lo[order], Below(hi[order])

    def places(self, x: np.ndarray, after: bool = False) -> np.ndarray:
        """The number of intervals that start before x (after: at x or before)."""
        return np.searchsorted(self.lo, x, "right" if after else "left")


def cogrouped(left: DataFrame, right: DataFrame, keys: list[str], count: Callable[[tuple, dict, dict], dict], schema: str) -> DataFrame:
    """The rows that count makes of each key's rows of both sides, both without nulls, as arrays by column."""

    def arrays(t: pa.Table) -> dict:
        return {c: t.column(c).to_numpy() for c in t.column_names if c not in keys}

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        found = count(tuple(k.as_py() for k in key), arrays(a), arrays(b)) if a.num_rows and b.num_rows else {}
        return pa.table(found) if found else pa.schema(wanted).empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = list(to_arrow_schema(StructType.fromDDL(schema)))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
