"""Stable hashes and draws that other programs can repeat: FNV-1a 64 and SplitMix64."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

M64 = (1 << 64) - 1
#: Fixed values of the two public algorithms.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def fnv1a64(data: bytes, state: int = FNV_BASIS) -> int:
    for b in data:
        state = (state ^ b) * FNV_PRIME & M64
    return state


def splitmix64(state: int) -> tuple[int, int]:
    """The next state and its output."""
    state = state + GOLDEN & M64
    z = (state ^ state >> 30) * MIX1 & M64
    z = (z ^ z >> 27) * MIX2 & M64
    return state, z ^ z >> 31


def draw(seed: int, parts: Sequence[str], total: int) -> int:
    """A number from 1 to total, fixed by seed and parts; every number is equally likely.

    The state is FNV-1a over the seed and, for each part, its byte length (eight little-endian bytes) and bytes; outputs
    below 2**64 mod total are passed over.
    """
    state = fnv1a64((seed & M64).to_bytes(8, "little"))
    for p in parts:
        raw = p.encode()
        state = fnv1a64(raw, fnv1a64(len(raw).to_bytes(8, "little"), state))
    while True:
        state, out = splitmix64(state)
        if out >= (1 << 64) % total:
            return out % total + 1


@F.pandas_udf(LongType())
def fnv1a64_column(s: pd.Series) -> pd.Series:
    """FNV-1a 64 of a string as a signed long; null stays null."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return pd.Series([None if x is None else signed(fnv1a64(x.encode())) for x in s], dtype="Int64")


def haplotype_id(atoms: Column) -> Column:
    """1 + FNV-1a 64 of the sorted atoms, each closed by ';', modulo 2**31 - 2: the same for any order of atoms."""
    key = F.concat(F.array_join(F.array_sort(atoms), ";"), F.lit(";"))
    return _haplotype(key)


@F.pandas_udf(LongType())
def _haplotype(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else 1 + fnv1a64(x.encode()) % (2**31 - 2) for x in s], dtype="Int64")
