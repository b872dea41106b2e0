"""Writers."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_category(df: DataFrame, categories: Column, path: str, contig: str = "contig") -> None:
    """One folder for each category and contig; a row goes to every category of its array, in one pass.

    Rows are dealt by category, contig and a salt first, so files are few and no contig is written by one task.
    """
    rows = df.withColumn("category", F.explode(categories))
    salt = F.pmod(F.xxhash64(*[c for c in ("qname", "pos") if c in df.columns] or [contig]), F.lit(16))
    rows.repartition("category", contig, salt).write.partitionBy("category", contig).parquet(path)


def evidence(rows: DataFrame, path: str) -> None:
    """Evidence (contig, kind, sv_id, ...) in one folder a kind and contig; salted, so no contig is one task's work."""
    rows.repartition("kind", "contig", F.pmod(F.xxhash64("sv_id"), F.lit(16))).write.mode("append").partitionBy("kind", "contig").parquet(path)


def split_by_flag(df: DataFrame, flag: Column, yes: str, no: str, strip: str | None = None) -> None:
    """Rows where flag holds to one place, the rest to another; strip: a column whose _DUP ending goes."""
    out = df.withColumn(strip, F.regexp_replace(strip, "_DUP$", "")) if strip else df
    held = F.coalesce(flag, F.lit(False))
    out.where(held).write.parquet(yes)
    out.where(~held).write.parquet(no)


def matched_sets(benchmark: DataFrame, called: DataFrame, matches: DataFrame, path: str) -> None:
    """tp, fp and fn of called against benchmark, by matches (benchmark_id, called_id)."""
    called.join(matches.select(F.col("called_id").alias("id")), "id", "left_semi").write.parquet(f"{path}/tp")
    called.join(matches.select(F.col("called_id").alias("id")), "id", "left_anti").write.parquet(f"{path}/fp")
    benchmark.join(matches.select(F.col("benchmark_id").alias("id")), "id", "left_anti").write.parquet(f"{path}/fn")


def key_values(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Space-separated text, one row a line."""
    df.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns]).alias("value")).write.text(path)


def table(df: DataFrame, path: str) -> None:
    """Tab-separated text with a heading in every part."""
    df.write.csv(path, sep="\t", header=True)


def vcf(lines: DataFrame, head: Sequence[str], path: str, order: Sequence[str] = ()) -> None:
    """Heading and records as text parts; the heading is the first part."""
    spark = lines.sparkSession
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("append").text(f"{path}/header")
    lines.select("value").write.text(f"{path}/records")


def manifest_hash(entries: Sequence[dict]) -> str:
    """SHA-256 over the entries' canonical JSON, without their paths, in sorted order."""
    kept = sorted(json.dumps({k: v for k, v in e.items() if k != "path"}, sort_keys=True, separators=(",", ":")) for e in entries)
    return hashlib.sha256("\n".join(kept).encode()).hexdigest()


def manifest(entries: Sequence[dict], path: str) -> str:
    """Write a manifest on the driver so that it is there whole or not at all; its hash."""
    found = manifest_hash(entries)
    with open(f"{path}.tmp", "w") as f:
        json.dump({"hash": found, "entries": list(entries)}, f, sort_keys=True, indent=1)
    os.replace(f"{path}.tmp", path)
    return found


def load_manifest(path: str) -> dict:
    with open(path) as f:
        out = json.load(f)
    if out["hash"] != manifest_hash(out["entries"]):
        raise ValueError("the manifest's hash does not fit its entries")
    return out
