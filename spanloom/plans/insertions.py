"""Insertions: clusters of stable reads, where their mates come from, and assembly of what was inserted."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import align, sequence
from ..operators import graph, ordered, ranges
from . import assembly


def stable_clusters(stable: DataFrame, reach: int, most: int, least: int) -> DataFrame:
    """Clusters of stable reads (contig, qname, lo, hi) whose mates lie elsewhere: contig, cluster, lo, hi, n."""
    a = stable.select("contig", "qname", F.col("lo").alias("ls"), F.col("hi").alias("le"), F.col("lo").alias("rs"), F.col("hi").alias("re"))
    c = graph.agglomerate(a, ["contig"], ("ls", "le"), ("rs", "re"), reach, most, ["qname"])
    named = ranges.sessions(c.where("cluster >= 0"), ["contig"], "ls", reach, "le", ["le", "qname"])
    out = named.groupBy("contig", F.concat_ws("/", "session", "cluster").alias("cluster")).agg(F.min("ls").alias("lo"), F.max("le").alias("hi"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least)


def facing_pairs(forward: DataFrame, reverse: DataFrame, max_is: int) -> DataFrame:
    """One-to-one pairs of a forward cluster and the reverse cluster behind it, at most max_is apart; most reads first."""
    f = forward.select("contig", F.col("cluster").alias("f"), F.col("hi").alias("f_hi"), F.col("n").alias("f_n"), (F.col("hi") - max_is).alias("w_lo"), (F.col("hi") + max_is).alias("w_hi"))
    r = reverse.select("contig", F.col("cluster").alias("r"), F.col("lo").alias("r_lo"), F.col("n").alias("r_n"))
    met = ranges.point_join(r, f, ["contig"], "r_lo", ("w_lo", "w_hi"), max_is).withColumn("score", F.col("f_n") + F.col("r_n")).select("contig", "f", "r", "f_hi", "r_lo", "score")
    return graph.greedy_matching(met, ["contig"], "f", "r", "score", descending=True).where("accepted").drop("accepted")


def source_windows(mates: DataFrame, width: int) -> DataFrame:
    """cluster, contig, start, score: the window in which most of a cluster's mates (cluster, contig, pos) lie, per contig."""
    return ordered.max_sum_window(mates.withColumn("_one", F.lit(1)), ["cluster", "contig"], "pos", "_one", width).select("cluster", "contig", (F.col("window_end") - width).alias("start"), F.col("window_sum").alias("score"))


def clip_support(clusters: DataFrame, consensuses: DataFrame, slack: int, k: int = 21) -> DataFrame:
    """cluster, chain: for each cluster the clip consensus near its end that shares most k-mers with its sequence."""
    c = clusters.select("contig", "cluster", F.col("seq").alias("c_seq"), (F.col("hi") - slack).alias("c_lo"), (F.col("hi") + slack).alias("c_hi"))
    p = consensuses.select("contig", "chain", "breakpoint", F.col("seq").alias("p_seq"))
    met = ranges.point_join(p, c, ["contig"], "breakpoint", ("c_lo", "c_hi"), max(1, slack))
    scored = met.withColumn("share", sequence.shared_kmers(F.col("p_seq"), F.col("c_seq"), k)).where("share > 0")
    return ordered.ranked(scored, ["cluster"], [F.desc("share"), "chain"]).select("cluster", "chain", "share")


def detect(contigs: Sequence[str], left_flank: str, right_flank: str, least_anchor: int = 20, join: int = 30) -> str | None:
    """What contigs say was inserted between two flanks; '-' stands for an unknown middle; None if they don't say.

    One contig that holds both anchors says it outright; else the best contigs of each side are joined where they overlap
    exactly, or left apart.
    """
    left, right = left_flank[-least_anchor:], right_flank[:least_anchor]
    for c in contigs:
        a = c.find(left)
        b = c.find(right, a + len(left)) if a >= 0 else -1
        if b >= 0:
            return c[a + len(left) : b]
    heads = [c[c.find(left) + len(left) :] for c in contigs if left in c]
    tails = [c[: c.find(right)] for c in contigs if right in c]
    if not heads or not tails:
        return None
    head, tail = max(heads, key=len), max(tails, key=len)
    if not head and not tail:
        return None
    return assembly.joined_flanks(head, tail, join)


def supported(ins: str, reads: Sequence[str], left_flank: str, right_flank: str, least: int = 3, span: int = 20, max_error: float = 0.05) -> bool:
    """Whether at least so many reads lie over each end of an insertion, span bases on both sides, with few differences."""
    parts = ins.split("-")
    ends = [(left_flank + parts[0], len(left_flank)), (parts[-1] + right_flank, len(parts[-1]))]
    for text, at in ends:
        n = 0
        for r in reads:
            p = align.best_placement(r, text)
            if p and p[1] <= max_error * len(r) and p[0] <= at - span and p[0] + len(r) >= at + span:
                n += 1
        if n < least:
            return False
    return True


def assembled_insertions(reads: DataFrame, flanks: DataFrame, overlap: int, most_reads: int) -> DataFrame:
    """locus, ins_seq, n_reads, too_deep: flanks (locus, left, right) and reads (locus, seq); null where nothing is told.

    Loci of more than most_reads reads are flagged, not cut.
    """
    n = reads.groupBy("locus").agg(F.count(F.lit(1)).alias("n_reads"))
    deep = n.where(F.col("n_reads") > most_reads)
    kept = reads.join(deep.select("locus"), "locus", "left_anti").join(flanks, "locus")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        left, right, seqs = g["left"].iloc[0], g["right"].iloc[0], sorted(g["seq"].dropna())
        found = detect(assembly.assemble([*seqs, left[-2 * overlap :], right[: 2 * overlap]], overlap), left, right)
        return pd.DataFrame({"locus": [g["locus"].iloc[0]], "ins_seq": [found], "n_reads": [len(g)], "too_deep": [False]})

    kind = reads.schema["locus"].dataType.simpleString()
    out = kept.select("locus", "seq", "left", "right").groupBy("locus").applyInPandas(run, f"locus {kind}, ins_seq string, n_reads long, too_deep boolean")
    return out.unionByName(deep.select("locus", F.lit(None).cast("string").alias("ins_seq"), "n_reads", F.lit(True).alias("too_deep")))
