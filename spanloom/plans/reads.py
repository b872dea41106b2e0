"""From alignments to evidence: categories, insert sizes, pair clusters, consensus votes, support of variants.

Alignments have the columns of sources.readers.READS. All stages are plans of joins and aggregates; Python runs only where
a scan or an alignment asks for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import align, predicates, sequence
from ..functions.types import struct
from ..operators import counting, coverage, graph, ordered, ranges, sets, stats


def categorised(reads: DataFrame, min_is: int, max_is: int, min_mapq: int = 20, min_clip: int = 15, min_diff: int = 3, min_size: int = 50) -> DataFrame:
    """Primary reads with their categories; poly-G tails don't count as clips."""
    kept = reads.where(predicates.is_primary() & ~predicates.is_unmapped() & ~predicates.poly_g_clip())
    return kept.withColumn("categories", predicates.routes(min_mapq, min_clip, min_diff, min_size, min_is, max_is))


def mates(reads: DataFrame) -> DataFrame:
    """reads with seq, qual and mapq of their mates: an equi join on the name and the other end."""
    end = F.when(predicates.flag(predicates.FIRST), 1).otherwise(2)
    own = reads.withColumn("_end", end)
    other = own.where(predicates.is_primary()).select("qname", (3 - F.col("_end")).alias("_end"), F.col("seq").alias("mate_seq"), F.col("qual").alias("mate_qual"), F.col("mapq").alias("mate_mapq"))
    return own.join(other, ["qname", "_end"], "left").drop("_end")


def insert_sizes(reads: DataFrame) -> DataFrame:
    """n, mean, sd, sd_below, sd_above, lo and hi of proper pairs' sizes, outliers cut; one row a contig."""
    proper = reads.where(predicates.flag(predicates.PROPER) & predicates.is_primary() & predicates.same_contig() & (F.col("isize") > 0))
    return stats.trimmed_moments(proper.select("contig", "isize"), ["contig"], "isize")


def base_quality_floor(reads: DataFrame) -> DataFrame:
    """First hundredth of reads' mean base qualities, per contig, from a histogram of whole qualities."""
    mean = F.floor(F.aggregate("qual", F.lit(0.0), lambda a, x: a + x) / F.size("qual"))
    return stats.histogram_tails(stats.histogram(reads.where(F.size("qual") > 0).withColumn("_q", mean), ["contig"], "_q"), ["contig"]).select("contig", F.col("low").alias("min_quality"))


def depth_windows(reads: DataFrame, width: int = 100, min_mapq: int = 0) -> DataFrame:
    """Largest depth per contig and window."""
    kept = reads.where(predicates.is_primary() & ~predicates.is_unmapped() & (F.col("mapq") >= min_mapq)).withColumn("_end", predicates.end())
    return coverage.window_max_depth(kept, ["contig"], "pos", "_end", width)


def pair_anchors(reads: DataFrame, kind: str, min_is: int, max_is: int) -> DataFrame:
    """One row a pair of a kind (long, outward, same_strand), told at its left read: the anchors of both ends."""
    k = predicates.pair_kind(min_is, max_is)
    of_kind = (predicates.same_contig() & predicates.same_strand()) if kind == "same_strand" else (k == kind)
    left = (F.col("pos") < F.col("mpos")) | ((F.col("pos") == F.col("mpos")) & predicates.flag(predicates.FIRST))
    rows = reads.where(predicates.is_primary() & of_kind & left)
    return rows.select("contig", "qname", F.col("pos").alias("ls"), predicates.end().alias("le"), F.col("mpos").alias("rs"), predicates.mate_end().alias("re"), "mapq", F.col("mq").alias("mate_mapq"))


def clusters(anchors: DataFrame, reach: int, most: int, least: int) -> DataFrame:
    """Merged anchors of clusters of at least ``least`` pairs, with their quality."""
    c = graph.agglomerate(anchors, ["contig"], ("ls", "le"), ("rs", "re"), reach, most, ["qname"])
    named = ranges.sessions(c.where("cluster >= 0"), ["contig"], "ls", reach, "le", ["le", "rs", "re", "qname"])
    out = named.groupBy("contig", "session", "cluster").agg(*[f(x).alias(x) for f, x in ((F.min, "ls"), (F.max, "le"), (F.min, "rs"), (F.max, "re"))], F.count(F.lit(1)).alias("n"), F.max("mapq").alias("max_mapq"), F.max("mate_mapq").alias("max_mate_mapq"))
    return out.where(F.col("n") >= least).drop("session", "cluster")


def pair_deletions(cl: DataFrame) -> DataFrame:
    """Imprecise deletions between the anchors of long pairs."""
    return cl.select("contig", F.col("le").alias("start"), F.col("rs").alias("end"), F.lit("DEL").alias("svtype"), F.lit(True).alias("imprecise"), F.col("n").alias("pairs")).where("start < end")


def pair_duplications(cl: DataFrame) -> DataFrame:
    """Imprecise duplications from the left to the right anchor of outward pairs."""
    return cl.select("contig", F.col("ls").alias("start"), F.col("re").alias("end"), F.lit("DUP").alias("svtype"), F.lit(True).alias("imprecise"), F.col("n").alias("pairs"))


def drop_explained(pairs: DataFrame, exact: DataFrame, slack: int, width: int = 10_000) -> DataFrame:
    """pairs (id, contig, start, end, svtype) but those that exactly one exact variant of their type explains."""
    p = pairs.select("*", (F.col("start") - slack).alias("_lo"), (F.col("end") + slack).alias("_hi"))
    e = exact.select("contig", "svtype", F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = ranges.contains_join(p, e, ["contig", "svtype"], ("_lo", "_hi"), ("_s", "_e"), width)
    once = met.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    return pairs.join(once, "id", "left_anti")


def clip_clusters(reads: DataFrame, min_clip: int, left: bool) -> DataFrame:
    """Clipped reads with the cluster of their breakpoint: chained on it, so that reads of one junction meet."""
    clip = predicates.left_clip() if left else predicates.right_clip()
    at = F.col("pos") if left else predicates.end()
    rows = reads.where(predicates.is_primary() & (clip >= min_clip)).withColumns({"breakpoint": at, "clip_length": clip, "_from": predicates.unclipped_start()})
    return ordered.anchored_chains(rows, ["contig"], "breakpoint", 5, ["qname", "flag"])


def clip_consensuses(clustered: DataFrame, least: int = 3) -> DataFrame:
    """contig, chain, start, seq, breakpoint, fwd, rev, max_mapq: base votes over clusters of at least so many reads."""
    key = ["contig", "chain"]
    big = clustered.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(~predicates.flag(predicates.REVERSE)).alias("fwd"), F.count_if(predicates.flag(predicates.REVERSE)).alias("rev"), F.max("mapq").alias("max_mapq")).where(F.col("n") >= least)
    votes = sets.consensus_bases(clustered.join(big.select(*key), key, "left_semi"), key, "seq", "qual", "_from")
    seq = votes.groupBy(*key).agg(F.min("pos").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"))
    point = stats.mode(clustered, key, "breakpoint").select(*key, F.col("mode").alias("breakpoint"))
    return seq.join(big, key).join(point, key)


def paired_consensuses(left: DataFrame, right: DataFrame, near: int = 10_000, least: int = 15) -> DataFrame:
    """Right-clipped and left-clipped consensuses within reach whose sequences overlap, best overlaps first, one to one."""
    r = right.select("contig", F.col("chain").alias("r_chain"), F.col("breakpoint").alias("r_at"), (F.col("breakpoint") + near).alias("r_hi"), F.col("seq").alias("r_seq"), (F.col("breakpoint") - near).alias("r_lo"))
    l = left.select("contig", F.col("chain").alias("l_chain"), F.col("breakpoint").alias("l_at"), F.col("seq").alias("l_seq"))
    met = ranges.point_join(l, r, ["contig"], "l_at", ("r_lo", "r_hi"), near)
    scored = met.withColumn("_o", _overlap("r_seq", "l_seq", F.lit(least))).where("_o.score is not null")
    pairs = scored.select("contig", "r_chain", "l_chain", "r_at", "l_at", "r_seq", "l_seq", F.col("_o.score").alias("score"), F.col("_o.length").alias("overlap"))
    return graph.greedy_matching(pairs, ["contig"], "r_chain", "l_chain", "score", descending=True).where("accepted").drop("accepted")


@F.pandas_udf(struct("score int, length int"))
def _overlap(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b, least in batches:
        rows = [(o if (o := align.scored_overlap(x, y, least=int(k))) and o[0] > 0 else (None, None)) for x, y, k in zip(a, b, least)]
        yield pd.DataFrame(rows, columns=["score", "length"], dtype="Int64")


@F.pandas_udf(struct("svtype string, start long, end long, ins_seq string"))
def junction_column(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """What a sequence over a breakpoint says against a reference window: a change in the window's own places."""
    for seq, ref in batches:
        rows = [align.junction(s, r) or (None,) * 4 if s and r else (None,) * 4 for s, r in zip(seq, ref)]
        yield pd.DataFrame(rows, columns=["svtype", "start", "end", "ins_seq"])


def pair_labels(pairs: DataFrame, deletions: DataFrame, min_is: int, max_is: int, slack: int = 5, width: int = 10_000) -> DataFrame:
    """sv_id, qname, label of pairs (contig, qname, lo, hi outer places) over deletions (id, contig, start, end).

    A pair that spans the deletion with an insert above max_is is alt if what the deletion leaves of it fits; one of usual
    size is ref if it is shorter than min_is plus the deletion, else neutral.
    """
    d = deletions.select("contig", F.col("id").alias("sv_id"), F.col("start").alias("d_lo"), F.col("end").alias("d_hi"))
    p = pairs.select("contig", "qname", "lo", "hi", *[c for c in ("mapq", "mate_mapq", "nm") if c in pairs.columns])
    met = ranges.range_join(p, d, ["contig"], ("lo", "hi"), ("d_lo", "d_hi"), width)
    size, span = F.col("hi") - F.col("lo"), F.col("d_hi") - F.col("d_lo")
    spans = (F.col("lo") <= F.col("d_lo") + slack) & (F.col("hi") >= F.col("d_hi") - slack)
    label = F.when((size > max_is) & spans & (size - span <= max_is), "alt").when(size.between(min_is, max_is), F.when(size < min_is + span, "ref").otherwise("neutral"))
    return met.withColumn("label", label).where("label is not null").drop("d_lo", "d_hi")


def duplication_labels(pairs: DataFrame, dups: DataFrame, slack: int = 5, width: int = 10_000) -> DataFrame:
    """As pair_labels, for duplications: outward pairs within are alt, pairs that hold an end of it ref, others neutral."""
    d = dups.select("contig", F.col("id").alias("sv_id"), F.col("start").alias("d_lo"), F.col("end").alias("d_hi"))
    met = ranges.range_join(pairs, d, ["contig"], ("lo", "hi"), ("d_lo", "d_hi"), width)
    inside = (F.col("lo") >= F.col("d_lo") - slack) & (F.col("hi") <= F.col("d_hi") + slack)
    over_end = ((F.col("lo") < F.col("d_lo")) & (F.col("hi") > F.col("d_lo"))) | ((F.col("lo") < F.col("d_hi")) & (F.col("hi") > F.col("d_hi")))
    label = F.when(F.col("outward") & inside, "alt").when(over_end & ~F.col("outward"), "ref").otherwise("neutral")
    return met.withColumn("label", label).drop("d_lo", "d_hi")


def duplication_counts(pairs: DataFrame, dups: DataFrame, slack: int = 5, width: int = 10_000) -> DataFrame:
    """sv_id, label, n: how many pairs duplication_labels gives each label, counted by bin without listing pairs of both."""
    d = dups.select("contig", F.col("id").alias("sv_id"), F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))
    kind = F.when(F.col("outward"), 1).when(~F.col("outward"), 0).otherwise(2)
    p = ranges.binned(pairs.where("contig is not null").select("contig", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), kind.alias("outward")), ("lo", "hi"), width, "_bin", "_first").drop("_first")
    v = ranges.binned(d.where("contig is not null"), ("s", "e"), width, "_bin", "_first").select("contig", "_bin", "sv_id", "s", "e")

    def labels(p: dict, s: np.ndarray, e: np.ndarray) -> dict:
        out, n = {"alt": np.zeros(len(s), np.int64), "ref": np.zeros(len(s), np.int64)}, np.zeros(len(s), np.int64)
        for kind in np.unique(p["outward"]):
            at = p["outward"] == kind
            x = counting.Spans(p["lo"][at], p["hi"][at])
            zero, end = np.zeros(len(s), np.int64), x.places(e, True)
            n += end - x.hi.count(zero, end, s)
            if kind == 1:
                begin = x.places(s - slack)
                out["alt"] = x.hi.count(begin, end, e + slack, True) - x.hi.count(begin, end, s)
            elif kind == 0:
                a, b = x.places(s), x.places(e)
                over = lambda r, y: r - x.hi.count(zero, r, y, True)  # noqa: E731, B023
                out["ref"] = over(a, s) + over(b, e) - over(a, e)
        return {**out, "neutral": n - out["alt"] - out["ref"]}

    def count(key: tuple, p: dict, v: dict) -> dict:
        # A pair counts in the later of the two first bins, as in range_join.
        new, born = v["s"] // width == key[1], p["lo"] // width == key[1]
        parts = [labels(q, v["s"][at], v["e"][at]) for at, q in ((new, p), (~new, {k: x[born] for k, x in p.items()}))]
        return {"sv_id": np.concatenate([v["sv_id"][new], v["sv_id"][~new]]), **{k: np.concatenate([x[k] for x in parts]) for k in ("alt", "ref", "neutral")}}

    kind_of_id = dict(v.dtypes)["sv_id"]
    found = counting.cogrouped(p, v, ["contig", "_bin"], count, f"sv_id {kind_of_id}, alt long, ref long, neutral long")
    total = found.groupBy("sv_id").agg(*[F.sum(k).alias(k) for k in ("alt", "ref", "neutral")])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("n")) for k in ("alt", "ref", "neutral")]))
    return total.select("sv_id", each.alias("x")).select("sv_id", "x.label", "x.n").where("n > 0")


def pair_support(labels: DataFrame, high: int = 20) -> DataFrame:
    """Counts and quality of the pairs of each label, one row a variant."""
    aggs = [c for x in ("alt", "ref", "neutral") for c in stats.support(x, F.col("label") == x, F.col("mapq") >= F.col("mate_mapq"), F.least("mapq", "mate_mapq"), high)]
    return labels.groupBy("sv_id").agg(*aggs)


def alleles(variants: DataFrame, contigs: DataFrame, flank: int) -> DataFrame:
    """variants with alt_seq and ref_seq: both alleles with flank bases on each side, and ref_from, the window's start."""
    lo = F.greatest(F.col("start") + 1 - flank, F.lit(0))
    j = variants.join(contigs, "chr")
    dup = F.when(F.col("svtype") == "DUP", F.substr("seq", (F.col("start") + 2).cast("int"), (F.col("end") - F.col("start")).cast("int"))).otherwise(F.coalesce("ins_seq", F.lit("")))
    inv = F.when(F.col("svtype") == "INV", sequence.reverse_complement(F.substr("seq", (F.col("start") + 2).cast("int"), (F.col("end") - F.col("start")).cast("int")))).otherwise(dup)
    last = F.when(F.col("svtype") == "DUP", F.col("start")).otherwise(F.col("end"))
    return j.withColumns({"alt_seq": sequence.alt_allele(F.col("seq"), F.col("start"), last, inv, flank), "ref_seq": F.substr("seq", (lo + 1).cast("int"), (F.col("end") + 1 + flank - lo).cast("int")), "ref_from": lo}).drop("seq")


def read_evidence(reads: DataFrame, variants: DataFrame, contigs: DataFrame, read_len: int, depth_cap: int = 1000, width: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Evidence rows (sv_id, read, kind alt / ref / er, score), and variants too deep to be told (sv_id, n).

    Reads that end within read_len - 1 of a variant's ends are aligned to both alleles: alt if that scores strictly more,
    er if both score alike, else ref. Depth is counted first, and a variant over depth_cap is flagged instead of sampled.
    """
    v = alleles(variants, contigs, read_len)
    spans = v.select(F.col("chr").alias("contig"), F.col("id").alias("sv_id"), F.explode(F.array("start", "end")).alias("_p")).select("contig", "sv_id", (F.col("_p") - read_len + 1).alias("v_lo"), (F.col("_p") + read_len - 1).alias("v_hi"))
    r = reads.where(predicates.is_primary() & ~predicates.is_unmapped()).select("contig", F.concat_ws("_", "qname", F.when(predicates.flag(predicates.FIRST), 1).otherwise(2)).alias("read"), "seq", F.col("pos").alias("r_lo"), (predicates.end() - 1).alias("r_hi"))
    met = ranges.range_join(r, spans, ["contig"], ("r_lo", "r_hi"), ("v_lo", "v_hi"), width).select("sv_id", "read", "seq").distinct()
    n = met.groupBy("sv_id").agg(F.count(F.lit(1)).alias("n"))
    deep = n.where(F.col("n") > depth_cap)
    usable = met.join(deep.select("sv_id"), "sv_id", "left_anti").join(v.select(F.col("id").alias("sv_id"), "alt_seq", "ref_seq"), "sv_id")
    scored = usable.withColumn("_s", _two_scores("seq", "alt_seq", "ref_seq"))
    kind = F.when(F.col("_s.alt") > F.col("_s.ref"), "alt").when(F.col("_s.alt") == F.col("_s.ref"), "er").otherwise("ref")
    return scored.select("sv_id", "read", kind.alias("kind"), F.greatest("_s.alt", "_s.ref").alias("score")), deep


@F.pandas_udf(struct("alt int, ref int"))
def _two_scores(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for reads, alts, refs in batches:
        rows = []
        for q, a, r in zip(reads, alts, refs):
            rows.append(tuple(x.score if x else 0 for x in (align.with_shortcut(q, a, mode="clipped"), align.with_shortcut(q, r, mode="clipped"))))
        yield pd.DataFrame(rows, columns=["alt", "ref"])


def genotype(evidence: DataFrame, deep: DataFrame, variants: DataFrame) -> DataFrame:
    """variants with alt_reads, ref_reads, er_reads, too_deep and a genotype by the share of alt reads."""
    n = evidence.groupBy(F.col("sv_id").alias("id")).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_reads") for k in ("alt", "ref", "er")])
    j = variants.join(n, "id", "left").na.fill(0, ["alt_reads", "ref_reads", "er_reads"]).join(deep.select(F.col("sv_id").alias("id"), F.lit(True).alias("too_deep")), "id", "left").na.fill(False, ["too_deep"])
    share = F.try_divide("alt_reads", F.col("alt_reads") + F.col("ref_reads"))
    return j.withColumn("gt", F.when(~F.col("too_deep"), predicates.inversion_call(share)))


def homopolymer_reads(reads: DataFrame, runs: DataFrame, width: int = 1000) -> DataFrame:
    """id, qname, length: the length of a run that reads over it with flanks show (runs: id, contig, start, end, base, left, right).

    left and right are the bases beside the run, by which it is found in the read.
    """
    r = reads.where(predicates.is_primary() & ~predicates.is_unmapped()).select("contig", "qname", "seq", F.col("pos").alias("r_lo"), (predicates.end() - 1).alias("r_hi"))
    u = runs.select("contig", "id", "base", "left", "right", F.col("start").alias("u_lo"), F.col("end").alias("u_hi"))
    met = ranges.contains_join(r, u, ["contig"], ("r_lo", "r_hi"), ("u_lo", "u_hi"), width)
    found = F.expr("regexp_extract(seq, concat(left, '(', base, '+)', right), 1)")
    return met.select("id", "qname", F.length(found).alias("length")).where("length > 0")


def homopolymer_indels(lengths: DataFrame, runs: DataFrame, least: int = 3) -> DataFrame:
    """Runs of which at least so many reads show another length than the reference: the most frequent other length."""
    j = lengths.join(runs.select("id", (F.col("end") - F.col("start") + 1).alias("ref_length")), "id").where("length <> ref_length")
    n = j.groupBy("id", "ref_length", "length").agg(F.count(F.lit(1)).alias("reads")).where(F.col("reads") >= least)
    return ordered.ranked(n, ["id"], [F.desc("reads"), "length"])


def training_drift(first: DataFrame, second: DataFrame, limit: float = 0.1) -> DataFrame:
    """id, unreliable: whether the share of alt reads of the same record moved more than limit between two runs."""
    j = first.select("id", F.col("ar").alias("a")).join(second.select("id", F.col("ar").alias("b")), "id")
    return j.select("id", (F.abs(F.col("a") - F.col("b")) > limit * F.greatest("a", "b", F.lit(1.0))).alias("unreliable"))


def best_regions(hits: DataFrame, k: int = 3) -> DataFrame:
    """The k windows of a cluster (cluster, contig, start, score) with the highest scores."""
    return ordered.ranked(hits, ["cluster"], [F.desc("score"), "contig", "start"], k, "rank")


def stray_pairs(pairs: DataFrame, variants: DataFrame, reach: int, width: int = 10_000) -> DataFrame:
    """sv_id, n: discordant pairs that begin within reach before a variant's start or end after its end, but explain nothing.

    Pairs are counted by their names.
    """
    v = variants.select("contig", F.col("id").alias("sv_id"), (F.col("start") - reach).cast("long").alias("v_lo"), (F.col("end") + reach).cast("long").alias("v_hi"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    # A pair of one place and a variant of one row are counted by bin; only what is left needs its names compared.
    p = pairs.where("discordant and contig is not null").select("contig", "qname", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    p = p.withColumn("_one", (F.count(F.lit(1)).over(Window.partitionBy("contig", "qname")) == 1) & F.col("qname").isNotNull() & F.col("hi").isNotNull() & F.col("lo").isNotNull())
    v = v.withColumn("_once", F.count(F.lit(1)).over(Window.partitionBy("sv_id")) == 1)
    once, again = v.where("_once").drop("_once"), v.where("not _once").drop("_once")

    def count(key: tuple, p: dict, v: dict) -> dict:
        x = counting.Spans(p["lo"], p["hi"])
        lo, hi, mid = x.places(v["v_lo"]), x.places(v["v_hi"], True), x.places(np.minimum(v["start"], v["v_hi"]), True)
        return {"sv_id": v["sv_id"], "n": hi - lo - (mid - lo - x.hi.count(lo, mid, v["end"]))}

    points = p.where("_one").select("contig", F.floor(F.col("lo") / F.lit(width)).cast("long").alias("_bin"), "lo", "hi")
    spans = ranges.binned(once.where("contig is not null and start is not null and end is not null"), ("v_lo", "v_hi"), width, "_bin", "_first").drop("_first")
    counted = counting.cogrouped(points, spans, ["contig", "_bin"], count, f"sv_id {dict(v.dtypes)['sv_id']}, n long")
    few = F.broadcast(again.select("contig").distinct())
    left = [(p.where("not _one"), once), (p.join(few, "contig", "left_semi"), again)]
    met = [ranges.point_join(x.drop("_one"), y, ["contig"], "lo", ("v_lo", "v_hi"), width).select("sv_id", "qname", "lo", "hi", "start", "end") for x, y in left]
    out = met[0].union(met[1]).where(~((F.col("lo") <= F.col("start")) & (F.col("hi") >= F.col("end"))))
    named = out.groupBy("sv_id").agg(F.count_distinct("qname").alias("n"))
    # A variant with no pair has no row; one whose pairs have no names has a row of 0.
    return counted.where("n > 0").union(named).groupBy("sv_id").agg(F.sum("n").alias("n"))


def support_columns(evidence: DataFrame, reads: DataFrame) -> DataFrame:
    """A11 over evidence joined with its reads: counts by strand and quality of each kind, one row a variant."""
    r = reads.select(F.concat_ws("_", "qname", F.when(predicates.flag(predicates.FIRST), 1).otherwise(2)).alias("read"), predicates.flag(predicates.MATE_REVERSE).alias("_fwd"), "mq")
    j = evidence.join(r, "read")
    aggs = [c for k in ("alt", "ref") for c in stats.support(k, F.col("kind") == k, F.col("_fwd"), F.col("mq"), 20)]
    return j.groupBy("sv_id").agg(*aggs)


def last_kind(column: str) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy("contig").orderBy("pos"))
