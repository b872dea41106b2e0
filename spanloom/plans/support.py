"""Stages between calls and genotypes: extended consensuses, targets of duplications, evidence of all types, reuse of work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align, predicates
from ..functions.types import struct
from ..operators import ordered, ranges
from . import assembly, reads as read_plans


def extended_consensuses(consensuses: DataFrame, sequences: DataFrame, least: int, block: int = 100, most: int = 500, max_reads: int = 5000) -> DataFrame:
    """consensuses (id, seq) with extended and added: the right end grown by reads, a block at a time, up to most bases.

    sequences (id, seq): what evidence.extension_reads gives for each; one with more than max_reads stays as it is.
    """
    n = sequences.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    fit = sequences.join(n.where(F.col("_n") <= max_reads).select("id"), "id", "left_semi").select("id", "seq", F.lit(1).alias("_kind"))
    both = consensuses.select("id", "seq", F.lit(0).alias("_kind")).unionByName(fit)

    def scan(rows: list[dict]) -> list[dict]:
        own = [r["seq"] for r in rows if not r["_kind"]]
        more = [r["seq"] for r in rows if r["_kind"]]
        out = []
        for seed in own:
            grown = seed
            while len(grown) - len(seed) < most:
                step = assembly.extended(grown, more, least, min(block, most - (len(grown) - len(seed))))
                if len(step) == len(grown):
                    break
                grown = step
            out.append({"id": rows[0]["id"], "extended": grown, "added": len(grown) - len(seed)})
        return out

    kind = consensuses.schema["id"].dataType.simpleString()
    return consensuses.join(ordered.per_group(both, ["id"], ["_kind", "seq"], scan, f"id {kind}, extended string, added int"), "id")


def duplication_targets(variants: DataFrame, contigs: DataFrame, read_len: int, min_clip: int = 10) -> DataFrame:
    """id, copies, alt_seq, ref_seq, large: allele sequences of duplications (chr, start, end, id).

    One that a read can span is small and comes with one to k more copies, as many as a read can hold; a large one has one
    sequence over its junction.
    """
    d = variants.where("svtype = 'DUP'").join(contigs, "chr")
    n, flank = F.col("end") - F.col("start"), F.lit(read_len)
    small = n <= read_len - 2 * min_clip
    unit = F.substr("seq", (F.col("start") + 2).cast("int"), n.cast("int"))
    left = F.substr("seq", F.greatest(F.col("start") + 2 - flank, F.lit(1)).cast("int"), F.least(flank, F.col("start") + 1).cast("int"))
    right = F.substr("seq", (F.col("end") + 2).cast("int"), flank)
    most = F.when(small, F.ceil(F.lit(read_len) / F.greatest(n, F.lit(1)))).otherwise(1)
    each = d.select("id", F.explode(F.sequence(F.lit(1), most.cast("int"))).alias("copies"), unit.alias("_u"), left.alias("_l"), right.alias("_r"), (~small).alias("large"))
    across = F.concat(F.substr("_u", F.greatest(F.length("_u") - read_len + 1, F.lit(1)), F.lit(read_len)), F.substr("_u", F.lit(1), F.lit(read_len)))
    alt = F.when(F.col("large"), across).otherwise(F.concat(F.col("_l"), F.expr("repeat(_u, copies + 1)"), F.col("_r")))
    return each.select("id", "copies", alt.alias("alt_seq"), F.concat("_l", "_u", "_r").alias("ref_seq"), "large")


@F.pandas_udf(struct("alt int, ref int"))
def _scores(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for qs, alts, refs in batches:
        rows = [tuple((x.score if (x := align.with_shortcut(q, t, mode="clipped")) else 0) for t in (a, r)) for q, a, r in zip(qs, alts, refs)]
        yield pd.DataFrame(rows, columns=["alt", "ref"])


def duplication_evidence(reads: DataFrame, variants: DataFrame, contigs: DataFrame, read_len: int, depth_cap: int = 1000, width: int = 1000) -> DataFrame:
    """sv_id, read, kind, score, copies: reads near duplications by their best number of copies; all that tie are listed.

    kind is alt if that beats the reference, er if both score alike, else ref (copies 0). Variants over depth_cap give none.
    """
    t = duplication_targets(variants, contigs, read_len)
    near = variants.where("svtype = 'DUP'").select(F.col("chr").alias("contig"), F.col("id").alias("sv_id"), F.explode(F.array("start", "end")).alias("_p")).select("contig", "sv_id", (F.col("_p") - read_len + 1).alias("v_lo"), (F.col("_p") + read_len - 1).alias("v_hi"))
    r = reads.where(predicates.is_primary() & ~predicates.is_unmapped()).select("contig", F.concat_ws("_", "qname", F.when(predicates.flag(predicates.FIRST), 1).otherwise(2)).alias("read"), "seq", F.col("pos").alias("r_lo"), (predicates.end() - 1).alias("r_hi"))
    met = ranges.range_join(r, near, ["contig"], ("r_lo", "r_hi"), ("v_lo", "v_hi"), width).select("sv_id", "read", "seq").distinct()
    deep = met.groupBy("sv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > depth_cap)
    usable = met.join(deep.select("sv_id"), "sv_id", "left_anti").join(t.withColumnRenamed("id", "sv_id"), "sv_id")
    scored = usable.withColumn("s", _scores("seq", "alt_seq", "ref_seq")).select("sv_id", "read", "copies", "s.alt", "s.ref")
    best = scored.groupBy("sv_id", "read").agg(F.max("alt").alias("best"), F.max("ref").alias("ref"))
    told = scored.select("sv_id", "read", "copies", "alt").join(best, ["sv_id", "read"])
    alts = told.where("best > ref and alt = best").select("sv_id", "read", F.lit("alt").alias("kind"), F.col("best").alias("score"), "copies")
    rest = best.where("best <= ref").select("sv_id", "read", F.when(F.col("best") == F.col("ref"), "er").otherwise("ref").alias("kind"), F.col("ref").alias("score"), F.lit(0).alias("copies"))
    return alts.union(rest)


def all_evidence(reads: DataFrame, variants: DataFrame, contigs: DataFrame, read_len: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Evidence of deletions, insertions and duplications and the variants too deep to be told; inversions have none kept.

    Types differ in how deep is too deep: four times the largest depth for deletions, eight for insertions.
    """
    out, deep = None, None
    for kind, times in (("DEL", 4), ("INS", 8)):
        found, over = read_plans.read_evidence(reads, variants.where(F.col("svtype") == kind), contigs, read_len, times * max_depth)
        out, deep = (found, over) if out is None else (out.unionByName(found), deep.unionByName(over))
    dup = duplication_evidence(reads, variants, contigs, read_len, 20 * max_depth).select("sv_id", "read", "kind", "score").distinct()
    return out.unionByName(dup), deep


def kept_evidence(spark: SparkSession, path: str, variants: DataFrame, kinds: tuple[str, ...] = ("alt", "ref", "er")) -> DataFrame:
    """Evidence rows that an earlier pass wrote (sources.writers.evidence), of these variants and kinds; folders are pruned."""
    rows = spark.read.parquet(path).where(F.col("kind").isin(*kinds))
    return rows.join(variants.select(F.col("id").alias("sv_id")), "sv_id", "left_semi")


def reused(requests: DataFrame, cache: str, build: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """requests with what build makes of them, from a cache (a Parquet folder) where an earlier pass made it.

    A request is named by a digest of its key columns, such as allele text and read names. build gets the different
    requests that the cache lacks and returns them with its columns; these are appended.
    """
    spark = requests.sparkSession
    text = F.to_json(F.struct(*key))
    named = requests.withColumn("_key", F.sha2(text, 256))
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    wanted = named.dropDuplicates(["_key"])
    if there:
        wanted = wanted.join(spark.read.parquet(cache).select("_key"), "_key", "left_anti")
    made = build(wanted)
    made.select("_key", *[c for c in made.columns if c not in wanted.columns]).write.mode("append").parquet(cache)
    return named.join(spark.read.parquet(cache), "_key").drop("_key")


def rescued_mates(anchors: DataFrame, runs: DataFrame, contigs: DataFrame, read_len: int, max_is: int, width: int = 1000) -> DataFrame:
    """id, qname, seq, score of unplaced mates that lie over homopolymers (id, contig, start, end) near their anchors.

    anchors: qname, contig, pos, reverse, mate_seq. A mate is turned round if its anchor is forward; it must align to the run
    with a read less a base on both sides, unclipped at its own 5' end.
    """
    a = anchors.withColumns({"a_lo": F.when(F.col("reverse"), F.col("pos") - max_is).otherwise(F.col("pos")), "a_hi": F.when(F.col("reverse"), F.col("pos")).otherwise(F.col("pos") + max_is)})
    u = runs.select("contig", "id", F.col("start").alias("u_lo"), F.col("end").alias("u_hi"))
    met = ranges.range_join(a, u, ["contig"], ("a_lo", "a_hi"), ("u_lo", "u_hi"), width)
    lo = F.greatest(F.col("u_lo") - (read_len - 1), F.lit(0))
    near = met.join(contigs, "contig").select("id", "qname", "reverse", "mate_seq", F.substr("seq", (lo + 1).cast("int"), (F.col("u_hi") + read_len - 1 - lo).cast("int")).alias("_ref"))
    placed = near.withColumn("_m", _placed_mate("mate_seq", "_ref", "reverse")).where("_m.score is not null")
    return placed.select("id", "qname", "_m.seq", "_m.score")


@F.pandas_udf(struct("seq string, score int"))
def _placed_mate(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    from ..functions.junctions import reverse_complement

    for mates, refs, reverse in batches:
        rows = []
        for m, r, back in zip(mates, refs, reverse):
            s = m if back else reverse_complement(m)
            a = align.with_shortcut(s, r) if s and r else None
            # The mate of a forward anchor is reversed: its 5' end is on the right.
            clipped = a is None or (a.q_start > 0 if back else a.q_end < len(s))
            rows.append((None, None) if clipped else (s, a.score))
        yield pd.DataFrame(rows, columns=["seq", "score"])


def run_consensus(reads: list[tuple[str, list[int], int, int, bool]], least: int = 3, quality: int = 40) -> tuple[str, int, int] | None:
    """Consensus of reads over one homopolymer: (sequence, where the run begins and ends in it).

    reads: (sequence, qualities, run's begin and end in the read, whether the left flank is the read's 5' side). Reads meet at
    the run's end. Where least reads have their 5' side on a flank, the other reads' bases there don't vote. Flanks end
    at the base nearest the run that neither least reads nor quality support; None if a base of the run has no vote.
    """
    from ..functions.junctions import consensus_of

    reach = max(r[3] for r in reads)
    seqs, quals, at = [], [], []
    for side in (True, False):
        sure = sum(r[4] == side for r in reads) >= least
        for s, q, a, e, five_left in reads if side else ():
            masked = list(s)
            if sure and not five_left:
                masked[:a] = "N" * a
            if sum(r[4] is False for r in reads) >= least and five_left:
                masked[e:] = "N" * (len(s) - e)
            seqs.append("".join(masked))
            quals.append(q)
            at.append(reach - e)
    seq, _ = consensus_of(seqs, at, quals)
    depth = [sum(o <= i < o + len(s) and s[i - o] != "N" for s, o in zip(seqs, at)) for i in range(len(seq))]
    power = [sum(q[i - o] for s, q, o in zip(seqs, quals, at) if o <= i < o + len(s) and s[i - o] == seq[i]) for i in range(len(seq))]
    begin = min(reach - e + a for _, _, a, e, _ in reads)
    if any(seq[i] == "N" for i in range(begin, reach)):
        return None
    good = lambda i: depth[i] >= least or power[i] >= quality and depth[i] > 0
    lo, hi = begin, reach
    while lo > 0 and good(lo - 1):
        lo -= 1
    while hi < len(seq) and good(hi):
        hi += 1
    return seq[lo:hi], begin - lo, reach - lo
