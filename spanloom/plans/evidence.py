"""Evidence of pairs and reads for variants: insertion and inversion pairs, reads to extend with, fields of support.

Alignments have the columns of sources.readers.READS; places are 0-based, ends exclusive unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import align, junctions, predicates, sequence
from ..functions.types import struct
from ..operators import ordered, ranges
from ..sources.vcf import support_tags


def best_ungapped(query: str, ref: str, least: int, match: int = 1, mismatch: int = -4) -> tuple[int, int]:
    """(overlap, differences) of the best placement without gaps that overlaps by least; the query may hang over either end."""
    q, r = align.codes(query), align.codes(ref)
    best = (-(1 << 30), 0, 0)
    for d in range(least - len(q), len(r) - least + 1):
        a, b = max(0, -d), min(len(q), len(r) - d)
        if b - a < least:
            continue
        off = int((q[a:b] != r[a + d : b + d]).sum())
        best = max(best, (match * (b - a - off) + mismatch * off, b - a, off), key=lambda x: x[0])
    return (best[1], best[2]) if best[0] > -(1 << 30) else (0, 0)


@F.pandas_udf(struct("fits bool, mismatches int"))
def fits_insertion(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Whether a mate lies in an inserted sequence: at least half of it, with at most this share of differences."""
    for mates, seqs, errors in batches:
        rows = []
        for m, s, e in zip(mates, seqs, errors):
            n, off = best_ungapped(m, s, max(1, len(m) // 2)) if m and s else (0, 0)
            rows.append((n > 0 and n >= (len(m) + 1) // 2 and off <= e * n, off))
        yield pd.DataFrame(rows, columns=["fits", "mismatches"])


def insertion_pair_labels(reads: DataFrame, insertions: DataFrame, mates: DataFrame, min_is: int, max_is: int, max_error: float = 0.04, width: int = 1000) -> DataFrame:
    """sv_id, qname, label, mapq, mate_mapq, nm, mate_nm of pairs at insertions (id, contig, start, end, ins_seq).

    Reads whose mates are kept apart (mates: read, seq) support the insertion, alt1 from the left and alt2 from the right, if
    the mate, turned to the reference's strand, lies in the inserted sequence; else they stray (stray1, stray2). Proper pairs
    over the place are ref1 if they are longer than max_is less the insertion, else neutral1.
    """
    r = reads.where(predicates.is_primary() & ~predicates.is_unmapped())
    end_no = F.concat_ws("_", "qname", F.when(predicates.flag(predicates.FIRST), 2).otherwise(1))
    rev = predicates.flag(predicates.REVERSE)
    base = r.select("contig", "qname", end_no.alias("mate"), rev.alias("rev"), "pos", predicates.end().alias("stop"), "mpos", "isize", F.length("seq").alias("n"), "mapq", F.col("mq").alias("mate_mapq"), "nm", predicates.pair_kind(min_is, max_is).alias("kind"), (F.col("isize") > 0).alias("first"))
    ins = insertions.select("contig", F.col("id").alias("sv_id"), F.col("start").alias("i_start"), F.col("end").alias("i_end"), "ins_seq")
    apart = base.join(mates.select(F.col("read").alias("mate"), F.col("seq").alias("mate_seq")), "mate", "left")
    alone = apart.where("mate_seq is not null").withColumns({"lo": F.when(F.col("rev"), F.col("pos") - max_is).otherwise(F.col("pos")), "hi": F.when(F.col("rev"), F.col("pos") - 1).otherwise(F.col("pos") + max_is - 1)})
    sides = ins.select("*", F.explode(F.array(F.struct(F.lit(False).alias("of"), F.col("i_start").alias("at")), F.struct(F.lit(True).alias("of"), F.col("i_end").alias("at")))).alias("x")).select("contig", "sv_id", "ins_seq", F.col("x.of").alias("rev"), F.col("x.at").alias("at"))
    met = ranges.point_join(sides, alone, ["contig", "rev"], "at", ("lo", "hi"), width)
    turned = F.when(F.col("rev"), F.col("mate_seq")).otherwise(sequence.reverse_complement(F.col("mate_seq")))
    fit = met.withColumn("_f", fits_insertion(turned, "ins_seq", F.lit(max_error)))
    side = F.when(F.col("rev"), "2").otherwise("1")
    one = fit.select("sv_id", "qname", F.concat(F.when(F.col("_f.fits"), "alt").otherwise("stray"), side).alias("label"), "mapq", "mate_mapq", "nm", F.col("_f.mismatches").alias("mate_nm"))
    inner = apart.where("mate_seq is null and kind = 'proper'")
    front = inner.where("not rev").withColumns({"lo": F.col("pos") + F.floor(F.col("n") / 2), "hi": F.col("mpos") + F.floor(F.col("n") / 2)}).where("lo <= hi")
    over = ranges.point_join(ins, front, ["contig"], "i_start", ("lo", "hi"), width)
    other = inner.where("rev").select("qname", F.col("nm").alias("mate_nm"))
    known = over.join(other, "qname")
    label = F.when(F.col("isize") > max_is - F.length("ins_seq"), "ref1").otherwise("neutral1")
    return one.union(known.select("sv_id", "qname", label.alias("label"), "mapq", "mate_mapq", "nm", "mate_nm"))


def inversion_pair_labels(reads: DataFrame, inversions: DataFrame, read_len: int, max_is: int, width: int = 1000) -> DataFrame:
    """sv_id, qname, label of same-strand pairs at inversions (id, contig, inv_start, inv_end): alt1 forward, alt2 reverse.

    Both reads must share half a read with the windows of max_is before the two ends (forward) or after them (reverse).
    """
    rev = predicates.flag(predicates.REVERSE)
    r = reads.where(predicates.is_primary() & ~predicates.is_unmapped() & predicates.same_contig() & predicates.same_strand())
    r = r.select("contig", "qname", rev.alias("rev"), "pos", predicates.end().alias("stop"), "mpos", predicates.mate_end().alias("mstop"), "mapq", F.col("mq").alias("mate_mapq"))
    r = r.where((~F.col("rev") & (F.col("mpos") < F.col("pos"))) | (F.col("rev") & (F.col("mpos") > F.col("pos"))))
    v = inversions.select("contig", F.col("id").alias("sv_id"), "inv_start", "inv_end")
    near = v.select("*", F.explode(F.array(F.struct(F.lit(False).alias("rev"), (F.col("inv_end") - max_is).alias("lo"), F.col("inv_end").alias("hi")), F.struct(F.lit(True).alias("rev"), F.col("inv_start").alias("lo"), (F.col("inv_start") + max_is).alias("hi")))).alias("w")).select("contig", "sv_id", "inv_start", "inv_end", "w.rev", "w.lo", "w.hi")
    met = ranges.range_join(r.withColumn("last", F.col("stop") - 1), near, ["contig", "rev"], ("pos", "last"), ("lo", "hi"), width)
    shared = lambda a, b, c, d: F.least(b, d) - F.greatest(a, c)
    mate_lo = F.when(F.col("rev"), F.col("inv_end")).otherwise(F.col("inv_start") - max_is)
    ok = (shared(F.col("pos"), F.col("stop"), F.col("lo"), F.col("hi")) >= read_len // 2) & (shared(F.col("mpos"), F.col("mstop"), mate_lo, mate_lo + max_is) >= read_len // 2)
    return met.where(ok).select("sv_id", "qname", F.when(F.col("rev"), "alt2").otherwise("alt1").alias("label"), "mapq", "mate_mapq")


def two_sided(clusters: DataFrame, consensuses: DataFrame, read_len: int, max_is: int, width: int = 1000) -> DataFrame:
    """cluster, left, right: consensuses that fit the two anchors of a same-strand cluster.

    clusters: cluster, contig, reverse, la_start, la_end, ra_start, ra_end; consensuses: id, contig, left_clipped, start,
    end, breakpoint. Reverse clusters want left-clipped consensuses before their anchors, forward ones right-clipped ones
    behind them. A consensus that fits both anchors belongs to the left one if its breakpoint lies within ten bases of it
    (reverse), or else to the right one; forward clusters the other way round.
    """
    c = clusters.select("cluster", "contig", F.col("reverse").alias("left_clipped"), "la_start", "la_end", "ra_start", "ra_end")
    half = read_len // 2
    rev = F.col("left_clipped")
    windows = {"l": (F.when(rev, F.col("la_start") - max_is).otherwise(F.col("la_end") - half), F.when(rev, F.col("la_start") + half).otherwise(F.col("la_end") + max_is)), "r": (F.when(rev, F.col("ra_start") - max_is).otherwise(F.col("ra_end") - half), F.when(rev, F.col("ra_end") + half).otherwise(F.col("ra_end") + max_is))}
    s = consensuses.select("contig", "left_clipped", F.col("id").alias("cid"), F.col("start").alias("c_lo"), F.col("end").alias("c_hi"), "breakpoint")
    hits = None
    for side, (lo, hi) in windows.items():
        w = c.select("*", lo.alias("w_lo"), hi.alias("w_hi"))
        met = ranges.range_join(w, s, ["contig", "left_clipped"], ("w_lo", "w_hi"), ("c_lo", "c_hi"), width).select("cluster", "cid", "breakpoint", "left_clipped", "la_start", "ra_end", F.lit(side).alias("side"))
        hits = met if hits is None else hits.union(met)
    both = F.count(F.lit(1)).over(Window.partitionBy("cluster", "cid")) > 1
    to_left = F.when(rev, F.col("breakpoint") <= F.col("la_start") + 10).otherwise(F.col("breakpoint") < F.col("ra_end") - 10)
    kept = hits.withColumn("_both", both).where(~F.col("_both") | (F.when(to_left, "l").otherwise("r") == F.col("side")))
    l, r = kept.where("side = 'l'").select("cluster", F.col("cid").alias("left")), kept.where("side = 'r'").select("cluster", F.col("cid").alias("right"))
    return l.join(r, "cluster", "full").where("left is null or right is null or left <> right")


def pairs_to_spans(pairs: DataFrame, spans: DataFrame, width: int = 1000) -> DataFrame:
    """pairs (qname, contig, reverse, start, end) with span: the first by priority of the spans (span, priority, contig,
    reverse, start, end) of their strand that hold them; a name is attached to a span once."""
    s = spans.select("contig", "reverse", "span", "priority", F.col("start").alias("s_lo"), F.col("end").alias("s_hi"))
    p = pairs.select("contig", "reverse", "qname", F.col("start").alias("p_lo"), F.col("end").alias("p_hi"))
    met = ranges.contains_join(s, p, ["contig", "reverse"], ("s_lo", "s_hi"), ("p_lo", "p_hi"), width)
    best = met.groupBy("contig", "reverse", "qname", "p_lo", "p_hi").agg(F.min_by("span", "priority").alias("span"))
    return best.groupBy("qname", "span").agg(F.min("p_lo").alias("start"), F.max("p_hi").alias("end"))


def extension_candidates(reads: DataFrame, max_depth: int) -> DataFrame:
    """Reads to extend consensuses with: at each start the read with the highest quality that is not clipped there, and up to
    max_depth clipped ones, which have a reason to begin at one place.

    Same-strand pairs may be an inversion's unstable end or a transposition's stable one, so the end that may be unstable
    comes a second time, turned round (turned is true).
    """
    left = predicates.left_clip() > 0
    kept = reads.where(predicates.is_primary() & ~predicates.is_unmapped()).withColumn("_clip", left)
    w = Window.partitionBy("contig", "pos", "_clip").orderBy(F.desc("mapq"), "qname", "flag")
    some = kept.withColumn("_r", F.row_number().over(w)).where((F.col("_clip") & (F.col("_r") <= max_depth)) | (~F.col("_clip") & (F.col("_r") == 1))).drop("_r")
    rev, mrev = predicates.flag(predicates.REVERSE), predicates.flag(predicates.MATE_REVERSE)
    either = predicates.same_contig() & predicates.same_strand() & (F.col("mapq") <= F.col("mq")) & ((~rev & (F.col("mpos") < F.col("pos"))) | (mrev & (F.col("mpos") > F.col("pos"))))
    again = kept.where(either)
    plain = lambda df, turned: df.select("contig", "qname", F.col("pos").alias("start"), (predicates.end() - 1).alias("end"), (rev if not turned else ~rev).alias("rev"), predicates.same_contig().alias("same_contig"), (sequence.reverse_complement(F.col("seq")) if turned else F.col("seq")).alias("seq"), (F.reverse("qual") if turned else F.col("qual")).alias("qual"), "mapq", predicates.flag(predicates.FIRST).alias("is_first"), F.lit(turned).alias("turned"))
    return plain(some, False).union(plain(again, True))


def extension_reads(candidates: DataFrame, targets: DataFrame, mates: DataFrame, min_is: int, max_is: int, read_len: int, max_reads: int, width: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Sequences for each target (target, contig, lo, hi, contig_len), ends included, and targets with more than max_reads.

    A read plays up to two parts: it overlaps the target, or its mate, mapped elsewhere, must lie there by the insert size:
    before it for forward reads (their mates come turned round), behind it for reverse ones. candidates need stable; mates
    (read, seq, qual, mapq) must hold every mate asked for, else an error says which is lacking.
    """
    t = targets.where("hi >= lo")
    f_lo, f_hi = F.greatest(F.lit(1), F.col("lo") - max_is + read_len), F.greatest(F.lit(1), F.col("hi") - min_is)
    r_lo, r_hi = F.least(F.col("lo") + min_is, F.col("contig_len")), F.least(F.col("hi") + max_is - read_len, F.col("contig_len"))
    t = t.select("target", "contig", "lo", "hi", f_lo.alias("f_lo"), f_hi.alias("f_hi"), r_lo.alias("r_lo"), r_hi.alias("r_hi"))
    t = t.withColumns({"w_lo": F.greatest(F.lit(0), F.least("f_lo", "r_lo") - 10), "w_hi": F.greatest("f_hi", "r_hi") + 10})
    c = candidates.withColumnsRenamed({"start": "c_lo", "end": "c_hi"})
    met = ranges.range_join(c, t, ["contig"], ("c_lo", "c_hi"), ("w_lo", "w_hi"), width)
    far = F.col("stable") & ~F.col("same_contig")
    ahead, behind = far & ~F.col("rev") & F.col("c_lo").between(F.col("f_lo"), F.col("f_hi")), far & F.col("rev") & F.col("c_hi").between(F.col("r_lo"), F.col("r_hi"))
    here = (F.col("c_hi") >= F.col("lo")) & (F.col("c_lo") <= F.col("hi"))
    roles = F.array_compact(F.array(F.when(ahead, F.lit("ahead")), F.when(behind, F.lit("behind")), F.when(here, F.lit("here"))))
    parts = met.select("target", "c_lo", "c_hi", "rev", "qname", "mapq", "seq", "qual", F.concat_ws("_", "qname", F.when(F.col("is_first"), 2).otherwise(1)).alias("read"), F.explode(roles).alias("role"))
    full = parts.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_reads)
    parts = parts.join(full.select("target"), "target", "left_anti")
    j = parts.join(mates.select("read", F.col("seq").alias("m_seq"), F.col("qual").alias("m_qual"), F.col("mapq").alias("m_mapq")), "read", "left")
    lost = F.assert_true((F.col("role") == "here") | F.col("m_seq").isNotNull(), F.concat(F.lit("no mate of "), F.col("read")))
    own = F.col("role") == "here"
    pick = lambda a, b, turn: F.when(own, F.col(a)).when(F.col("role") == "ahead", turn(F.col(b))).otherwise(F.col(b))
    out = j.where(F.coalesce(lost.cast("string"), F.lit("")) == "")
    cols = [pick("seq", "m_seq", sequence.reverse_complement).alias("seq"), pick("qual", "m_qual", F.reverse).alias("qual"), F.when(own, F.col("mapq")).otherwise(F.col("m_mapq")).alias("mapq"), F.when(own, F.col("c_lo")).otherwise(0).alias("start")]
    return out.select("target", "qname", "role", *cols), full


def semi_mapped(reads: DataFrame, min_is: int, max_is: int, min_clip: int = 10, min_mapq: int = 20) -> DataFrame:
    """Proper pairs' reads without N, with the kind of help they are for insertion clusters: semi_mapped or junction_mate.

    semi_mapped: the mate is barely clipped and as sure as the read. junction_mate: the mate is clipped only on the side that
    an insertion would cut.
    """
    l, r = (F.coalesce(c, F.lit(0)) for c in (predicates.mate_left_clip(), predicates.mate_right_clip()))
    clean = (l == 0) & (r == 0)
    semi = clean | ((l < min_clip) & (r < min_clip) & (F.col("mq") >= min_mapq) & (F.col("mq") >= F.col("mapq")))
    mrev = predicates.flag(predicates.MATE_REVERSE)
    at_junction = (F.col("mq") >= min_mapq) & F.when(mrev, (l >= min_clip) & (r < min_clip)).otherwise((r >= min_clip) & (l < min_clip))
    kind = F.when(semi, "semi_mapped").when(at_junction, "junction_mate")
    proper = predicates.pair_kind(min_is, max_is) == "proper"
    kept = reads.where(predicates.is_primary() & ~predicates.is_unmapped() & proper & ~F.col("seq").contains("N"))
    return kept.select("contig", "qname", "seq", "qual", mrev.alias("mate_reverse"), F.col("mpos").alias("m_lo"), predicates.mate_end().alias("m_hi"), kind.alias("kind")).where("kind is not null")


def attach_semi_mapped(helpers: DataFrame, clusters: DataFrame, max_is: int, slack: int = 5, width: int = 1000) -> DataFrame:
    """cluster, qname: helpers of semi_mapped for clusters (cluster, contig, right, start, end, breakpoint), each once.

    Semi-mapped ones need their mates within max_is before a right cluster's end or after a left one's start; junction mates
    need the mate's clipped end at the cluster's breakpoint. A read goes to its first cluster, ordinary help before the other.
    """
    cl = clusters.select("contig", "cluster", (~F.col("right")).alias("mate_reverse"), F.when(F.col("right"), F.col("end") - max_is).otherwise(F.col("start")).alias("w_lo"), F.when(F.col("right"), F.col("end")).otherwise(F.col("start") + max_is).alias("w_hi"), (F.col("breakpoint") - slack).alias("b_lo"), (F.col("breakpoint") + slack).alias("b_hi"))
    near = ranges.contains_join(cl, helpers.where("kind = 'semi_mapped'").select("contig", "mate_reverse", "qname", "m_lo", "m_hi"), ["contig", "mate_reverse"], ("w_lo", "w_hi"), ("m_lo", "m_hi"), width)
    point = helpers.where("kind = 'junction_mate'").select("contig", "mate_reverse", "qname", F.when(F.col("mate_reverse"), F.col("m_lo")).otherwise(F.col("m_hi")).alias("at"))
    cut = ranges.point_join(point, cl, ["contig", "mate_reverse"], "at", ("b_lo", "b_hi"), width)
    both = near.select("qname", "cluster", F.lit(0).alias("o")).union(cut.select("qname", "cluster", F.lit(1).alias("o")))
    return ordered.ranked(both, ["qname"], ["o", "cluster"]).select("cluster", "qname")


# Read overlaps for correction


def read_overlaps(reads: DataFrame, k: int = 15, anchors: int = 2, least: int = 30, margin: int = 10) -> DataFrame:
    """locus, target, read, offset, begin, end: how reads lie on the target reads of their locus (locus, read, seq, target).

    Offsets with at least two shared k-mers are candidates; the best local segment of each is scored (1 for a match, -4 for a
    difference) and must have 30 bases. The best offset counts if it is the only one or ahead by 10.
    """
    mers = reads.select("locus", "read", "target", F.posexplode(sequence.kmers(F.col("seq"), k)).alias("p", "kmer")).where(~F.col("kmer").rlike("[^ACGT]"))
    t = mers.where("target").select("locus", "kmer", F.col("read").alias("t"), F.col("p").alias("t_p"))
    # Sizes are estimated from the table that reads are made of, many times too small: none of these is to be broadcast.
    met = t.join(mers.select("locus", "kmer", "read", "p").hint("merge"), ["locus", "kmer"]).where("t <> read")
    found = met.groupBy("locus", "t", "read", (F.col("t_p") - F.col("p")).alias("offset")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= anchors)
    seqs = reads.select("locus", F.col("read").alias("t"), F.col("seq").alias("a")), reads.select("locus", "read", F.col("seq").alias("b"))
    scored = found.join(seqs[0].hint("merge"), ["locus", "t"]).join(seqs[1].hint("merge"), ["locus", "read"]).withColumn("s", best_segment("a", "b", "offset")).where(F.col("s.end") - F.col("s.begin") >= least)
    w = Window.partitionBy("locus", "t", "read")
    ranked = scored.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("s.score"), "offset")), "_n": F.count(F.lit(1)).over(w), "_next": F.lead("s.score").over(w.orderBy(F.desc("s.score"), "offset"))})
    best = ranked.where((F.col("_r") == 1) & ((F.col("_n") == 1) | (F.col("s.score") - F.col("_next") >= margin)))
    return best.select("locus", F.col("t").alias("target"), "read", "offset", "s.begin", "s.end")


@F.pandas_udf(struct("score int, begin int, end int"))
def best_segment(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The best scoring stretch of b placed at an offset on a, in places of a."""
    for xs, ys, ds in batches:
        rows = []
        for x, y, d in zip(xs, ys, ds):
            lo, hi = max(0, d), min(len(x), len(y) + d)
            if hi <= lo:
                rows.append((0, 0, 0))
                continue
            step = np.where(align.codes(x)[lo:hi] == align.codes(y)[lo - d : hi - d], 1, -4)
            upto = np.concatenate(([0], np.cumsum(step)))
            low = np.minimum.accumulate(upto)
            gain = upto - low
            e = int(np.argmax(gain))
            b = int(np.flatnonzero(upto[: e + 1] == low[e])[-1])
            rows.append((int(gain[e]), lo + b, lo + e))
        yield pd.DataFrame(rows, columns=["score", "begin", "end"])


# Fields of support


def field_column(tag: str) -> str:
    """The column of a field: mQ and MQ differ only in case, which column names don't tell apart."""
    return {"mQ": f"{tag[:-2]}_min_q", "MQ": f"{tag[:-2]}_max_q"}.get(tag[-2:], tag)


def _moments(prefix: str, keep: Column, x: Column, mean: str, sd: str) -> list[Column]:
    return [F.avg(F.when(keep, x)).alias(f"{prefix}{mean}"), F.stddev_pop(F.when(keep, x)).alias(f"{prefix}{sd}")]


def read_fields(evidence: DataFrame, high: int = 60) -> DataFrame:
    """sv_id and the read fields of both alleles and breakpoints, in one pass.

    evidence: sv_id, allele (A or R), bp (1 or 2), read, consistent, fwd, score, mapq, exclusive, start, end. For allele a and
    breakpoint k: aRk reads, aRkC consistent ones, by strand (CF, CR), of high quality (CHQ), extremes, mean and deviation of
    quality (CmQ, CMQ: see field_column, CAQ, CSQ) and score (CAS, CSS), the consistent ones' span (CMSPAN) and that of high quality
    (CMHQSPAN), and exclusive reads, all (E...) and consistent ones (CE...), alike.
    """
    aggs: list[Column] = []
    for a in "AR":
        for k in "12":
            p = f"{a}R{k}"
            base = (F.col("allele") == a) & (F.col("bp") == int(k))
            ok, hq, fwd, sole = F.coalesce("consistent", F.lit(False)), F.col("mapq") >= high, F.col("fwd"), F.coalesce("exclusive", F.lit(False))
            n = lambda c, name: F.count_if(c).alias(name)
            q = lambda c, name: [F.min(F.when(c, F.col("mapq"))).alias(field_column(f"{name}mQ")), F.max(F.when(c, F.col("mapq"))).alias(field_column(f"{name}MQ"))]
            span = lambda c: F.max(F.when(c, F.col("end"))) - F.min(F.when(c, F.col("start")))
            c = base & ok
            aggs += [n(base, p), n(c, f"{p}C"), n(c & fwd, f"{p}CF"), n(c & ~fwd, f"{p}CR"), n(c & hq, f"{p}CHQ"), *q(c, f"{p}C")]
            aggs += [*_moments(p, c, F.col("score"), "CAS", "CSS"), *_moments(p, c, F.col("mapq"), "CAQ", "CSQ"), span(c).alias(f"{p}CMSPAN"), span(c & hq).alias(f"{p}CMHQSPAN")]
            for part, name in ((base & sole, f"{p}E"), (c & sole, f"{p}CE")):
                aggs += [n(part, name), n(part & hq, f"{name}HQ"), *q(part, name), n(part & fwd, f"{name}F"), n(part & ~fwd, f"{name}R")]
    return evidence.groupBy("sv_id").agg(*aggs)


def pair_fields(pairs: DataFrame, high: int = 60) -> DataFrame:
    """sv_id and the pair fields: for allele (A, R, N) and breakpoint, and stray pairs (S), counts, both ends' qualities and differences.

    pairs: sv_id, label (as insertion_pair_labels gives: alt, ref, neutral or stray and the breakpoint), mapq, mate_mapq, nm.
    Fields of two values are arrays, the positive strand's first.
    """
    aggs: list[Column] = []
    for name, a in (("alt", "A"), ("ref", "R"), ("neutral", "N"), ("stray", "S")):
        for k in "12":
            p, c = f"{a}SP{k}" if a != "S" else f"SSP{k}", F.col("label") == f"{name}{k}"
            two = lambda f: F.array(f(F.when(c, F.col("mapq"))), f(F.when(c, F.col("mate_mapq"))))
            aggs += [F.count_if(c).alias(p), F.array(F.count_if(c & (F.col("mapq") >= high)), F.count_if(c & (F.col("mate_mapq") >= high))).alias(f"{p}HQ"), two(F.min).alias(field_column(f"{p}mQ")), two(F.max).alias(field_column(f"{p}MQ")), two(F.avg).alias(f"{p}AQ"), two(F.stddev_pop).alias(f"{p}SQ")]
            aggs += [F.avg(F.when(c, F.col("nm"))).alias(f"{p}NMA"), F.stddev_pop(F.when(c, F.col("nm"))).alias(f"{p}NMS")]
    return pairs.groupBy("sv_id").agg(*aggs)


def support_record(variants: DataFrame, *fields: DataFrame) -> DataFrame:
    """variants with fmt, a map of every support field as text: what was not computed, and what a field lacks, is '.'.

    All fields are set anew, so what an earlier pass left is gone.
    """
    j = variants
    for f in fields:
        j = j.join(f.withColumnRenamed("sv_id", "id"), "id", "left")
    have = {c for f in fields for c in f.columns} - {"sv_id"}
    entries = []
    for name, _, kind in support_tags():
        text, c = F.lit(None).cast("string"), field_column(name)
        if c in have:
            one = (lambda x: F.round(x, 4).cast("string")) if kind == "Float" else (lambda x: x.cast("string"))
            is_list = dict(j.dtypes)[c].startswith("array")
            text = F.array_join(F.transform(c, lambda x: F.coalesce(one(x), F.lit("."))), ",") if is_list else one(F.col(c))  # noqa: B023
        entries += [F.lit(name), F.coalesce(text, F.lit("."))]
    return j.withColumn("fmt", F.create_map(*entries)).drop(*have)


def copied_fields(records: DataFrame, source: DataFrame, keep_info: list[str] | None = None, samples: list[str] | None = None) -> DataFrame:
    """records with info and fmt of source rows of the same id added where they lack a key; a subset of keys and samples."""
    s = source if samples is None else source.where(F.col("sample").isin(samples))
    pick = F.col("info") if keep_info is None else F.map_filter("info", lambda k, _: k.isin(keep_info))
    other = s.select("id", pick.alias("_info"), F.col("fmt").alias("_fmt"))
    more = lambda a, b: F.coalesce(F.map_concat(F.map_filter(F.col(b), lambda k, _: ~F.coalesce(F.map_contains_key(F.col(a), k), F.lit(False))), F.coalesce(F.col(a), F.create_map().cast("map<string,string>"))), F.col(a))
    return records.join(other, "id", "left").withColumns({"info": more("info", "_info"), "fmt": more("fmt", "_fmt")}).drop("_info", "_fmt")


def fragment_links(sites: DataFrame, by: list[str]) -> DataFrame:
    """by, i, j, same, opposite: how fragments that inform on two sites agree (site, informative, supporting: arrays).

    Pairs with one side at least four times the other are kept, as assembly.phase wants them.
    """
    a = sites.select(*by, F.col("site").alias("i"), F.col("informative").alias("x"), F.col("supporting").alias("p"))
    b = sites.select(*by, F.col("site").alias("j"), F.col("informative").alias("y"), F.col("supporting").alias("q"))
    shared = F.array_intersect("x", "y")
    met = a.join(b, by).where("i < j").withColumn("_s", shared)
    same = F.size(F.filter("_s", lambda f: F.array_contains("p", f) == F.array_contains("q", f)))
    told = met.select(*by, "i", "j", same.alias("same"), (F.size("_s") - same).alias("opposite"))
    return told.where("(same > 0 and same >= 4 * opposite) or (opposite > 0 and opposite >= 4 * same)")


# Contexts of single bases


def context_likelihoods(observations: DataFrame, max_error: float = 0.04) -> DataFrame:
    """group, position, a, b, loglik of the ten genotypes of each position at which contexts differ.

    observations: group, position, base, qual, one a read. A base of an error over max_error says nothing.
    """
    error = F.least(F.lit(0.75), F.pow(F.lit(10.0), -F.col("qual") / 10.0))
    seen = observations.where(F.col("base").isin(*predicates.BASES)).withColumn("_e", error).where(F.col("_e") <= max_error)
    n = seen.groupBy("group", "position", "base", "_e").agg(F.count(F.lit(1)).alias("_n"))
    genotypes = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(predicates.BASES) for b in predicates.BASES[i:]])).alias("g")
    each = n.select("group", "position", "base", "_e", "_n", genotypes)
    p = lambda allele: F.when(F.col("base") == allele, 1 - F.col("_e")).otherwise(F.col("_e") / 3)
    return each.groupBy("group", "position", "g.a", "g.b").agg(F.sum(F.col("_n") * F.log((p(F.col("g.a")) + p(F.col("g.b"))) / 2)).alias("loglik"))


def surviving_contexts(contexts: DataFrame, likelihoods: DataFrame) -> DataFrame:
    """contexts (group, context, position, base) as group, context, survives: whether its bases are in best genotypes everywhere.

    Where no context of a group survives, all do. Positions without observations say nothing.
    """
    best = F.max("loglik").over(Window.partitionBy("group", "position"))
    top = likelihoods.withColumn("_b", best).where(F.col("_b") - F.col("loglik") <= 1e-9)
    allowed = top.groupBy("group", "position").agg(F.array_union(F.collect_set("a"), F.collect_set("b")).alias("bases"))
    j = contexts.join(allowed, ["group", "position"], "left")
    ok = j.groupBy("group", "context").agg(F.min(F.coalesce(F.array_contains("bases", F.col("base")), F.lit(True))).alias("ok"))
    some = F.max("ok").over(Window.partitionBy("group"))
    return ok.withColumn("survives", F.col("ok") | ~some).drop("ok")


def uncontradicted(atoms: DataFrame, reads: DataFrame) -> DataFrame:
    """atoms but those that reads of their variant contradict (junctions.contradicted).

    atoms: id, atom, with_atom, atom_lo, atom_hi, without, main_lo, main_hi, main_ref; reads: id, qname, seq.
    """
    both = atoms.select("id", "atom", F.struct("with_atom", "atom_lo", "atom_hi", "without", "main_lo", "main_hi", "main_ref").alias("x"), F.lit(None).cast("string").alias("qname"), F.lit(None).cast("string").alias("seq"))
    both = both.unionByName(reads.select("id", F.lit(None).cast(atoms.schema["atom"].dataType).alias("atom"), F.lit(None).cast(both.schema["x"].dataType).alias("x"), "qname", "seq"))

    def scan(rows: list[dict]) -> list[dict]:
        pairs = [(r["qname"], r["seq"]) for r in rows if r["x"] is None]
        out = []
        for r in rows:
            if r["x"] is not None:
                x = r["x"]
                bad = junctions.contradicted(x["with_atom"], (x["atom_lo"], x["atom_hi"]), x["without"], (x["main_lo"], x["main_hi"]), x["main_ref"], pairs)
                out.append({"id": r["id"], "atom": r["atom"], "bad": bad})
        return out

    kinds = {c: atoms.schema[c].dataType.simpleString() for c in ("id", "atom")}
    told = ordered.per_group(both, ["id"], ["qname"], scan, f"id {kinds['id']}, atom {kinds['atom']}, bad boolean")
    return atoms.join(told.where("bad").select("id", "atom"), ["id", "atom"], "left_anti")


