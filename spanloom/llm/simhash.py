"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart both lie within half the radius of some common value. Every distinct
fingerprint therefore emits all values within half the radius; values that two fingerprints share are where pairs meet.
All fingerprints in one such bucket are within the radius of each other (triangle inequality; for an odd radius of those that
are within its lower half of the value), so a bucket is joined by edges to its smallest such member, in proportion to its
size; each edge is verified again by its own bit count.

Defined cases: a null text counts as empty; a text without a word has the fingerprint zero and links like any other; a
text of fewer words than a shingle has one shingle, the whole sequence; repeated rows stay, each with its component; a
null doc_id stays a member but never names a component unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import Scratch, connected_components, tidy

SEED = 42
CHUNK = 1 << 14


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The 64-bit SimHash of one text; A-Z count as a-z, repeated shingles count again."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    whole = b" ".join(w)
    if len(w) <= size:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[: len(w) - size])).tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    digest, n, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py(), size) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return run


def _appended(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py(), size) for t in b.column("text").cast(pa.binary())), np.uint64, b.num_rows)
            yield b.append_column("_sl_fp", pa.array(got.view(np.int64)))

    return run


def ball(fp: str, half: int) -> F.Column:
    """All values within ``half`` bits of a fingerprint column."""
    masks = [0] + [sum(1 << i for i in c) for k in range(1, half + 1) for c in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    flips = F.array(*[F.lit(m).cast("long") for m in signed])
    return F.transform(flips, lambda m: F.col(fp).bitwiseXOR(m))


def with_fingerprint(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id as long and fp (signed 64-bit) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(_fingerprints(size)), "doc_id long, fp long")


def components(prints: DataFrame, scratch: Scratch, radius: int = 2) -> DataFrame:
    """fp, component_id and the fp of that row, for every distinct fingerprint of prints (doc_id, fp)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("fp").alias("of")))
    classes = scratch.table(prints.groupBy("fp").agg(first.alias("first")), "classes")
    met = classes.select("fp", F.explode(ball("fp", (radius + 1) // 2)).alias("at"))
    # An odd radius is half on one side and a bit more on the other: the smallest is one of those within the lower half.
    close = F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("at"))) <= radius // 2, F.col("fp"))
    pairs = met.select(F.col("fp").alias("v"), F.min(close).over(Window.partitionBy("at")).alias("u")).where("u <> v")
    edges = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    linked = connected_components(edges, scratch)
    named = scratch.table(classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "named")
    least = scratch.table(named.groupBy("component").agg(F.min("first").alias("least")), "least")
    out = scratch.table(named.join(least, "component").select("fp", F.col("least.id").alias("component_id"), F.col("least.of").alias("component_fp")), "components")
    scratch.drop(classes, named, least)
    return out


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit) and component_id, the smallest doc_id that links reach, for every row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(with_fingerprint(docs, size), "fingerprints")
    return prints.join(components(prints, scratch, radius), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = 2, size: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """One row of docs for each component: the one with the smallest doc_id (null last, then by fingerprint).

    Of repeated rows with that id and fingerprint one stays. Columns are those of docs. A scratch that is given can be closed
    once the result is written.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    schema = StructType([*docs.schema.fields, StructField("_sl_fp", LongType())])
    marked = scratch.table(docs.mapInArrow(tidy(_appended(size)), schema), "documents")
    found = components(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_sl_fp").alias("fp")), scratch, radius)
    key = ["_sl_no_id", "_sl_id", "_sl_fp"]
    split_id = [F.col("id").isNull().alias("_sl_no_id"), F.coalesce("id", F.lit(0)).alias("_sl_id")]
    kept = scratch.table(found.where("fp = component_fp").select(F.col("component_id").alias("id"), F.col("fp").alias("_sl_fp")).select(*split_id, "_sl_fp"), "kept")
    rows = marked.withColumns({"_sl_no_id": F.col("doc_id").isNull(), "_sl_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
