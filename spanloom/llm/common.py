"""What the operators share: word rules, and the package's scratch tables and connected components by short names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..tables import Scratch, shared_folder

__all__ = ["BLANK", "Scratch", "connected_components", "remainder", "shared_folder", "tidy", "words"]

#: Characters between words: space and tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; an empty array where there is none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and what it used goes back to the machine when a task ends: workers live on and would keep their largest size."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return told
