"""Homopolymer indels: runs of the reference, lengths that reads show, calibrated thresholds, alleles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, sequence
from ..operators import ordered, stats


def reference_runs(contigs: DataFrame, least: int = 5, flank: int = 5, piece: int = 1_000_000) -> DataFrame:
    """contig, start, end (half-open), base, left, right of all runs of at least ``least`` bases.

    Contigs are cut into pieces that overlap by the longest run looked for (piece / 10), so a long one is many tasks' work;
    a run is told by the piece in which it begins.
    """
    lap = piece // 10
    cut = contigs.select("contig", F.length("seq").alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(piece))).alias("lo"), "seq")
    from_ = F.greatest(F.col("lo") - flank - 1, F.lit(0))
    parts = cut.select("contig", "lo", from_.alias("from"), F.substr("seq", from_ + 1, F.lit(piece + lap + 2 * flank + 1)).alias("part")).repartition("contig", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for contig, lo, at, part in zip(*(b.column(c).to_pylist() for c in ("contig", "lo", "from", "part"))):
                for s, e in sequence.homopolymers(part, least):
                    if lo <= at + s < lo + piece and not (s == 0 and at):
                        rows.append((contig, at + s, at + e, part[s], part[max(0, s - flank) : s], part[e : e + flank]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["contig", "start", "end", "base", "left", "right"])

    return parts.mapInArrow(run, "contig string, start long, end long, base string, left string, right string")


def stutter_profile(lengths: DataFrame, reach: int = 3) -> DataFrame:
    """base, length, delta (cut to +-reach), reads, rate: how often reads of a run of that length show another one."""
    delta = F.greatest(F.least(F.col("shown") - F.col("length"), F.lit(reach)), F.lit(-reach))
    n = lengths.groupBy("base", "length", delta.alias("delta")).agg(F.count(F.lit(1)).alias("reads"))
    total = lengths.groupBy("base", "length").agg(F.count(F.lit(1)).alias("_t"))
    return n.join(total, ["base", "length"]).withColumn("rate", F.col("reads") / F.col("_t")).drop("_t")


def tail_errors(tails: DataFrame) -> DataFrame:
    """base, length, position, quality, observations, errors, error: mismatches of bases behind a run."""
    key = ["base", "length", "position", "quality"]
    n = tails.groupBy(*key).agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("mismatch")).alias("errors"))
    return n.withColumn("error", F.col("errors") / F.col("observations"))


def recalibrated(bases: DataFrame, errors: DataFrame, least: int = 100) -> DataFrame:
    """bases (base, length, position, quality) with a quality by the errors seen, pooled until there are enough.

    The own bin is used if it has ``least`` observations, else that of all qualities at the place, else that of the run's
    length, else the quality stays; it is cut to 0..40, and missing qualities stay missing.
    """
    own = errors.where(F.col("observations") >= least).select("base", "length", "position", "quality", F.col("error").alias("_e1"))
    pooled = lambda key, name: errors.groupBy(*key).agg(F.sum("observations").alias("_o"), F.sum("errors").alias("_x")).where(F.col("_o") >= least).select(*key, (F.col("_x") / F.col("_o")).alias(name))
    j = bases.join(own, ["base", "length", "position", "quality"], "left").join(pooled(["base", "length", "position"], "_e2"), ["base", "length", "position"], "left").join(pooled(["base", "length"], "_e3"), ["base", "length"], "left")
    e = F.coalesce("_e1", "_e2", "_e3")
    q = F.when(e.isNotNull(), F.round(numeric.error_phred(F.greatest(e, F.lit(1e-4))))).otherwise(F.col("quality"))
    return j.withColumn("new_quality", F.when(F.col("quality").isNotNull(), numeric.clamp(q, 0, 40)).cast("int")).drop("_e1", "_e2", "_e3")


def thresholds(rates: DataFrame, default: float = 0.1, cap: float = 0.75) -> DataFrame:
    """base, length, median, mad, threshold: the largest share of mismatches that a read over such a run may have."""
    return stats.mad_threshold(rates, ["base", "length"], "mismatch_rate", "reads", default, cap)


def summaries(lengths: DataFrame, key: str = "id") -> DataFrame:
    """Mode (the smaller of equals), quartile distance and number of the lengths that reads show of a run."""
    m = stats.mode(lengths, [key], "length")
    return m.join(lengths.groupBy(key).agg(stats.iqr("length").alias("iqr"), F.count(F.lit(1)).alias("n_reads")), key)


def alleles(lengths: DataFrame, key: str = "id", most: int = 2) -> DataFrame:
    """id, allele, reads: the two most frequent lengths; every other read goes to the nearest, the shorter of equals."""
    h = lengths.groupBy(key, "length").agg(F.count(F.lit(1)).alias("n"))
    top = ordered.ranked(h, [key], [F.desc("n"), "length"], most).select(key, F.col("length").alias("allele"))
    near = h.join(top, key).withColumn("_d", F.abs(F.col("length") - F.col("allele")))
    home = ordered.ranked(near, [key, "length"], ["_d", "allele"])
    return home.groupBy(key, "allele").agg(F.sum("n").alias("reads"))


def diploid(counts: dict[int, int], profile: dict[int, dict[int, float]]) -> tuple[int, int, float]:
    """The pair of allele lengths that explains observed lengths best, and its lead over the next pair in log units."""
    kernels = {n: numeric.stutter_kernel(n, profile.get(n, {})) for n in counts}
    pairs = sorted(((numeric.diploid_likelihood(counts, kernels[a], kernels[b]), a, b) for a in kernels for b in kernels if a <= b), reverse=True)
    return pairs[0][1], pairs[0][2], pairs[0][0] - pairs[1][0] if len(pairs) > 1 else float("inf")


def genotyped(lengths: DataFrame, profile: dict[int, dict[int, float]], key: str = "id") -> DataFrame:
    """id, first, second, lead per run; a run's reads are bounded by the depth guard before this stage."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b, lead = diploid(g["length"].value_counts().to_dict(), profile)
        return pd.DataFrame({key: [g[key].iloc[0]], "first": [a], "second": [b], "lead": [min(lead, 1e9)]})

    kind = lengths.schema[key].dataType.simpleString()
    return lengths.select(key, "length").groupBy(key).applyInPandas(run, f"{key} {kind}, first int, second int, lead double")


def in_run(start: Column, end: Column, run_start: Column, run_end: Column, inserted: Column, least: int = 3) -> Column:
    """Whether an indel lies in a run that has at least so many bases with what it inserts."""
    return (start >= run_start - 1) & (end <= run_end) & (run_end - run_start + F.length(inserted) >= least)
