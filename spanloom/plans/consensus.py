"""Consensus sequences of clipped reads: sliding clusters, haplotypes by k-mers, acceptance, merging, and changes from them.

Reads here have contig, qname, is_reverse, start and end (half-open, with clips: the unclipped span), left_clip, right_clip,
read_start and read_end (aligned span), seq, qual, mapq, nm and score, the alignment's own. Consensuses have contig,
left_clipped, start, end, breakpoint, seq, qual, fwd, rev, max_mapq, lowq_prefix, lowq_suffix, indels (sizes of net indels of
their reads) and is_hidden (too few clips to tell the breakpoint). Scans run over sessions of overlapping rows, one at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import junctions, predicates
from ..functions.types import SIMPLE
from ..operators import ordered, ranges

CONSENSUS = "contig string, left_clipped boolean, start long, end long, breakpoint long, seq string, qual array<int>, fwd int, rev int, max_mapq int, lowq_prefix int, lowq_suffix int, indels array<int>, is_hidden boolean, clip_len int, n_reads int"


def read_score(match: int = 1, mismatch: int = -4, gap_open: int = -6, gap_extend: int = -1) -> Column:
    """Score of a read's own alignment from its CIGAR and NM: differences that are not indels are mismatches in M."""
    of = lambda *ops: F.aggregate(F.filter("cigar", lambda x: x["op"].isin(*ops)), F.lit(0), lambda a, x: a + x["len"])
    gaps = F.aggregate(F.filter("cigar", lambda x: x["op"].isin("I", "D")), F.lit(0), lambda a, x: a + gap_open + (x["len"] - 1) * gap_extend)
    in_m = F.greatest(F.lit(0), F.col("nm") - of("I", "D") - of("X"))
    matches = of("=") + F.greatest(F.lit(0), of("M") - in_m)
    return gaps + match * matches + mismatch * (of("X") + in_m)


def clip_reads(reads: DataFrame) -> DataFrame:
    """Alignments (sources.readers.READS) as the reads of this module."""
    kept = reads.where(predicates.is_primary() & ~predicates.is_unmapped())
    net = F.aggregate(F.filter("cigar", lambda x: x["op"].isin("I", "D")), F.lit(0), lambda a, x: a + F.when(x["op"] == "I", x["len"]).otherwise(-x["len"]))
    cols = [predicates.flag(predicates.REVERSE).alias("is_reverse"), predicates.unclipped_start().alias("start"), (predicates.end() + predicates.right_clip()).alias("end"), predicates.left_clip().alias("left_clip"), predicates.right_clip().alias("right_clip"), F.col("pos").alias("read_start"), predicates.end().alias("read_end"), "seq", "qual", "mapq", "nm", read_score().alias("score"), net.alias("net_indel")]
    return kept.select("contig", "qname", *cols)


def sliding_clusters(reads: list[dict]) -> list[list[dict]]:
    """Runs of reads in order of their starts: a read joins while it shares half of the shorter one with the run's front.

    When it doesn't, the run so far is a cluster (of three or more), and its front reads go until it fits again, so clusters
    can share reads.
    """
    same = lambda a, b: min(a["end"], b["end"]) - max(a["start"], b["start"]) >= min(len(a["seq"]), len(b["seq"])) // 2
    run: list[dict] = []
    out = []
    for r in reads:
        if run and not same(run[0], r):
            if len(run) >= 3:
                out.append(list(run))
            while run and not same(run[0], r):
                run.pop(0)
        run.append(r)
    if len(run) >= 3:
        out.append(run)
    return out


def offsets(reads: list[dict]) -> list[int]:
    """Where each read stands on the first one, by its unclipped start or end, moved so that the smallest is 0."""
    first = reads[0]
    out = [junctions.placement_offset(first["seq"], r["seq"], r["start"] - first["start"], (r["end"] - first["end"]) - (len(r["seq"]) - len(first["seq"]))) for r in reads]
    return [o - min(out) for o in out]


def accepted(seq: str, reads: list[dict], at: list[int], min_diff: int = 2, min_size: int = 50, max_error: float = 0.04) -> list[bool]:
    """Reads that differ little from a consensus and fit it much better than the reference, or show an indel of SV size."""
    told = []
    for r, o in zip(reads, at):
        ok = junctions.passes_mismatches(r["seq"], seq, o, r["is_reverse"], max_error)
        if ok:
            lo, hi = r["left_clip"], len(r["seq"]) - r["right_clip"]
            off = junctions.align.mismatches_at(r["seq"], seq, o)
            new = len(r["seq"]) - 5 * off
            better = new - r["score"] >= 5 * min_diff
            told.append(better or abs(r["net_indel"]) >= min_size and new > r["score"] and lo <= hi)
        else:
            told.append(False)
    return told


def whole_consensus(reads: list[dict], by_kmer: bool, **options) -> tuple[str, list[int], list[bool]]:
    """Consensus of reads, its qualities and which of them it accepts.

    By k-mer, only the reads of the haplotype that the most telling place names vote; if fewer than three are accepted, those
    of the runner-up at this place are tried.
    """
    at = offsets(reads)

    def told(members: list[int]) -> tuple[str, list[int], list[bool]]:
        base = min(at[i] for i in members)
        seq, qual = junctions.consensus_of([reads[i]["seq"] for i in members], [at[i] - base for i in members], [reads[i]["qual"] for i in members])
        ok = accepted(seq, [reads[i] for i in members], [at[i] - base for i in members], **options)
        good = {i for i, x in zip(members, ok) if x}
        return seq, qual, [i in good for i in range(len(reads))]

    if not by_kmer:
        return told(list(range(len(reads))))
    members, next_ones = junctions.haplotype_split([r["seq"] for r in reads], at, [r["qual"] for r in reads])
    out = told(members)
    if sum(out[2]) < 3 and len(next_ones) >= 3:
        return told(next_ones)
    return out


def mate_window(reads: list[dict], left: bool, min_is: int, max_is: int, start: int, end: int) -> tuple[int, int]:
    """Where the other side of the breakpoint can lie, by the reads that look towards it."""
    facing = [r for r in reads if r["is_reverse"] == left]
    if not facing:
        return -(2**31), 2**31 - 1
    if left:
        return max(r["end"] for r in facing) - max_is, min(r["end"] for r in facing) - min_is + max_is
    return max(r["start"] for r in facing) + min_is - max_is, min(r["start"] for r in facing) + max_is


def cluster_consensuses(reads: list[dict], contig_seq: str, min_clip: int = 10, min_diff: int = 2, min_size: int = 50, least: int = 3) -> list[dict]:
    """The consensuses of one cluster: build, accept, classify, and again with the reads that were rejected.

    Where too few reads are accepted, clipped ones go once, as noisy tails can drown hidden split reads. The breakpoint is the
    most frequent clip of accepted reads (the smallest for left-clipped ones, the largest for right-clipped); under three
    clips it is the end of the consensus and the consensus is hidden.
    """
    left = sorted(reads, key=lambda r: (r["start"], r["qname"]))
    out = []
    options = {"min_diff": min_diff, "min_size": min_size}
    while len(left) >= least:
        seq, _, ok = whole_consensus(left, True, **options)
        if sum(ok) < least:
            seq, _, ok = whole_consensus(left, False, **options)
        good, rest = [r for r, x in zip(left, ok) if x], [r for r, x in zip(left, ok) if not x]
        if len(good) < least:
            plain = [r for r in left if r["left_clip"] < min_clip and r["right_clip"] < min_clip]
            if len(plain) == len(left):
                break
            left = plain
            continue
        left = rest
        seq, qual, _ = whole_consensus(good, False, **options)
        start, end = min(r["start"] for r in good), max(r["end"] for r in good)
        kind = junctions.classify(seq, contig_seq[max(0, start - 10) : end + 10], min_clip, min_diff, min_size)
        if kind == "ALIGNS_WELL":
            continue
        on_left = kind == "LEFT"
        clips = Counter(r["read_start"] if on_left else r["read_end"] for r in good if r["left_clip" if on_left else "right_clip"] >= min_clip)
        best = min(clips.items(), key=lambda x: (-x[1], x[0] if on_left else -x[0]), default=None)
        hidden = best is None or best[1] < 3
        point = (start if on_left else end) if best is None else best[0]
        clip = 0 if hidden else (point - start if on_left else end - point)
        row = {"contig": good[0].get("contig"), "left_clipped": on_left, "start": start, "end": end, "breakpoint": point, "seq": seq, "qual": qual, "fwd": sum(not r["is_reverse"] for r in good), "rev": sum(r["is_reverse"] for r in good)}
        out.append(row | {"max_mapq": max(r["mapq"] for r in good), "lowq_prefix": 0, "lowq_suffix": 0, "indels": sorted({r["net_indel"] for r in good if r["net_indel"]}), "is_hidden": hidden, "clip_len": clip, "n_reads": len(good)})
    return out


def build(reads: DataFrame, contigs: DataFrame, max_cluster: int = 10_000, min_clip: int = 10, min_diff: int = 2, min_size: int = 50) -> DataFrame:
    """All consensuses of clip_reads rows; contigs have contig and seq.

    Sessions of overlapping reads are dealt to tasks with their stretch of the reference. A cluster of more than max_cluster
    reads is a collapsed repeat and gives none, as does one that reaches beyond the contig's start.
    """
    cut = ranges.sessions(reads, ["contig"], "start", 0, "end", ["qname"])
    span = cut.groupBy("contig", "session").agg(F.greatest(F.min("start") - 10, F.lit(0)).alias("_lo"), (F.max("end") + 10).alias("_hi"))
    near = span.join(contigs, "contig").select("contig", "session", "_lo", F.substr("seq", (F.col("_lo") + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int")).alias("_ref"))

    def scan(rows: list[dict]) -> list[dict]:
        lo, ref = rows[0]["_lo"], rows[0]["_ref"]
        moved = [r | {"start": r["start"] - lo, "end": r["end"] - lo, "read_start": r["read_start"] - lo, "read_end": r["read_end"] - lo} for r in rows]
        out, seen = [], set()
        for c in sliding_clusters(moved):
            if len(c) > max_cluster or min(r["start"] for r in c) + lo < 0:
                continue
            for x in cluster_consensuses(c, ref, min_clip, min_diff, min_size):
                key = (x["left_clipped"], x["start"], x["end"], x["seq"])
                if key not in seen:
                    seen.add(key)
                    out.append(x | {k: x[k] + lo for k in ("start", "end", "breakpoint")})
        return out

    return ordered.per_group(cut.join(near, ["contig", "session"]), ["contig", "session"], ["start", "qname"], scan, CONSENSUS)


# Consensuses among themselves


def confident(c: dict) -> tuple[str, list[int]]:
    """Sequence and qualities without the low-quality ends."""
    end = len(c["seq"]) - c["lowq_suffix"]
    return c["seq"][c["lowq_prefix"] : end], c["qual"][c["lowq_prefix"] : end]


def drop_contained(rows: list[dict], trusted: int = 20) -> list[dict]:
    """rows but those whose confident part lies in a wider one's span and agrees with it; surer bases are taken over."""
    kept = sorted((dict(r, qual=list(r["qual"])) for r in rows), key=lambda r: (r["start"], -r["end"], r["seq"]))
    gone: set[int] = set()
    for i, a in enumerate(kept):
        if i in gone:
            continue
        for j in range(i + 1, len(kept)):
            b = kept[j]
            if b["start"] > a["end"]:
                break
            if j in gone or a["indels"] != b["indels"] or b["end"] > a["end"]:
                continue
            seq, qual = confident(b)
            for at in range(len(a["seq"]) - len(seq) + 1):
                if junctions.placement_agrees(a["seq"], a["qual"], at, seq, qual, trusted):
                    better = [k for k in range(len(seq)) if qual[k] > a["qual"][at + k]]
                    letters = list(a["seq"])
                    for k in better:
                        letters[at + k], a["qual"][at + k] = seq[k], qual[k]
                    a["seq"] = "".join(letters)
                    gone.add(j)
                    break
    return [r for i, r in enumerate(kept) if i not in gone]


def merged_pair(a: dict, b: dict, least: int, deviation: int = 10, trusted: int = 20) -> dict | None:
    """Two overlapping consensuses, a the left one, as one; None if their sequences or the sides they look for disagree.

    They must share half of the shorter one by place, and by sequence as much within deviation; the confident parts are
    compared first.
    """
    if a["indels"] != b["indels"]:
        return None
    shared = a["end"] - b["start"]
    if shared < min(len(a["seq"]), len(b["seq"])) // 2:
        return None
    for whole in (False, True):
        cut_a, cut_b = (0, 0) if whole else (a["lowq_suffix"], b["lowq_prefix"])
        x, qx = a["seq"][: len(a["seq"]) - cut_a], a["qual"][: len(a["qual"]) - cut_a]
        y, qy = b["seq"][cut_b:], b["qual"][cut_b:]
        by_place = shared - cut_a - cut_b
        short = min(len(x), len(y))
        if not whole and not short // 2 <= by_place < short:
            continue
        n = next((n for n in range(short, least - 1, -1) if junctions.placement_agrees(x, qx, len(x) - n, y, qy, trusted)), 0)
        if n:
            if abs(n - by_place) > deviation:
                return None
            seq, qual = junctions.joined(x, qx, y, qy, n)
            first = a if a["left_clipped"] else b
            point = a["breakpoint"] if a["left_clipped"] else b["breakpoint"]
            out = {**a, "start": a["start"], "end": b["end"], "breakpoint": point, "seq": seq, "qual": qual, "lowq_prefix": a["lowq_prefix"], "lowq_suffix": b["lowq_suffix"], "is_hidden": a["is_hidden"] and b["is_hidden"], "clip_len": first["clip_len"]}
            return out | {"fwd": a["fwd"] + b["fwd"], "rev": a["rev"] + b["rev"], "max_mapq": max(a["max_mapq"], b["max_mapq"]), "n_reads": a["n_reads"] + b["n_reads"]}
    return None


def merge_overlapping(rows: list[dict], least: int) -> list[dict]:
    """rows with overlapping ones merged: the best supported takes its left neighbours from right to left, then the right ones."""
    rows = sorted(rows, key=lambda r: (r["start"], r["end"], r["seq"]))
    alive = dict(enumerate(rows))
    for i in sorted(alive, key=lambda i: (-(rows[i]["fwd"] + rows[i]["rev"]), i)):
        if i not in alive:
            continue
        for j in sorted((j for j in alive if j != i and alive[j]["start"] < alive[i]["start"] and alive[j]["end"] < alive[i]["end"]), key=lambda j: (-alive[j]["end"], j)):
            if alive[j]["end"] < alive[i]["start"]:
                break
            m = merged_pair(alive[j], alive[i], least)
            if m is not None:
                alive[i] = m
                del alive[j]
        for j in sorted((j for j in alive if j != i and alive[j]["start"] > alive[i]["start"] and alive[j]["end"] > alive[i]["end"]), key=lambda j: (alive[j]["start"], j)):
            if alive[j]["start"] > alive[i]["end"]:
                break
            m = merged_pair(alive[i], alive[j], least)
            if m is not None:
                alive[i] = m
                del alive[j]
    return [alive[i] for i in sorted(alive)]


def processed(consensuses: DataFrame, contigs: DataFrame, least: int = 75, ploidy: int = 8, min_clip: int = 10, min_diff: int = 2) -> DataFrame:
    """consensuses without contained ones, overlapping ones merged, without poly-G tails, and at most ploidy over a place.

    The order is fixed. Left- and right-clipped ones are apart; the better supported ones keep their place.
    """
    key = ["contig", "left_clipped"]
    cut = ranges.sessions(consensuses, key, "start", 0, "end", ["seq"])
    span = cut.groupBy(*key, "session").agg(F.greatest(F.min("start") - 10, F.lit(0)).alias("_lo"), (F.max("end") + 10).alias("_hi"))
    near = span.join(contigs, "contig").select(*key, "session", "_lo", F.substr("seq", (F.col("_lo") + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int")).alias("_ref"))

    def scan(rows: list[dict]) -> list[dict]:
        lo, ref = rows[0]["_lo"], rows[0]["_ref"]
        found = merge_overlapping(drop_contained(rows), least)
        window = lambda c: ref[max(0, c["start"] - 10 - lo) : c["end"] + 10 - lo]
        return [c for c in found if not junctions.poly_g(c["seq"], window(c), c["fwd"], c["rev"], min_clip, min_diff)]

    kept = ordered.per_group(cut.join(near, [*key, "session"]), [*key, "session"], ["start", "end", "seq"], scan, CONSENSUS)
    ranked = kept.withColumn("_n", F.col("fwd") + F.col("rev"))
    return ordered.accept_by_capacity(ranked, key, "start", "end", "_n", ["start", "end", "seq"], ploidy).where("accepted").drop("accepted", "_n")


@F.pandas_udf(SIMPLE["string"])
def classify_column(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """junctions.classify of a consensus against its stretch of the reference."""
    for seqs, refs in batches:
        yield pd.Series([junctions.classify(s, r) if s and r else None for s, r in zip(seqs, refs)], dtype=object)


# Changes of reads that no consensus used


def read_changes(support: DataFrame, high: int = 60) -> DataFrame:
    """Changes that at least two unused reads show (contig, start, end, svtype, ins_seq, mapq; deep, deep_high by place).

    Where depth is excessive, two reads of high quality are asked for, and none is kept where that of good reads is, too.
    """
    key = ["contig", "start", "end", "svtype", "ins_seq"]
    n = support.groupBy(*key).agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("mapq") >= high).alias("high_reads"), F.max("deep").alias("deep"), F.max("deep_high").alias("deep_high"))
    ok = ~F.coalesce("deep", F.lit(False)) | (~F.coalesce("deep_high", F.lit(False)) & (F.col("high_reads") >= 2))
    return n.where((F.col("reads") >= 2) & ok).drop("deep", "deep_high").withColumn("source", F.lit("READ"))


def companions(changes: DataFrame, reads: DataFrame, indels: DataFrame) -> DataFrame:
    """id, start, end, ins_seq, reads, spanning: indels that two reads of a change show, and more than half of those that span.

    changes: id, start, end; reads (id, qname, read_start, read_end): those that show the change; indels (id, qname, start,
    end, ins_seq): all others they show. What meets the change itself is left out, as are both of two that overlap.
    """
    shown = indels.join(reads, ["id", "qname"]).where((F.col("read_start") <= F.col("start")) & (F.col("read_end") > F.col("end") + 1))
    n = shown.groupBy("id", "start", "end", "ins_seq").agg(F.count_distinct("qname").alias("reads"))
    span = n.select("id", F.struct("start", "end", "ins_seq", F.col("reads").alias("n")).alias("x")).join(reads, "id").where((F.col("read_start") <= F.col("x.start")) & (F.col("read_end") > F.col("x.end") + 1))
    told = span.groupBy("id", "x").agg(F.count_distinct("qname").alias("spanning")).select("id", "x.start", "x.end", "x.ins_seq", F.col("x.n").alias("reads"), "spanning")
    own = changes.select("id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    apart = told.where((F.col("reads") >= 2) & (2 * F.col("reads") > F.col("spanning"))).join(own, "id")
    apart = apart.where(~((F.col("start") == F.col("_s")) | ((F.col("start") < F.col("_e")) & (F.col("_s") <= F.col("end"))))).drop("_s", "_e")
    w = Window.partitionBy("id").orderBy("start", "end", "ins_seq")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("start").over(w.rowsBetween(1, Window.unboundedFollowing))
    same = F.count(F.lit(1)).over(Window.partitionBy("id", "start"))
    clash = (F.coalesce(F.col("start") < before, F.lit(False))) | F.coalesce(after < F.col("end"), F.lit(False)) | (same > 1)
    return apart.withColumn("_clash", clash).where("not _clash").drop("_clash")


# Clusters of stable reads that share a clip consensus


def merge_clusters(members: DataFrame, max_is: int) -> DataFrame:
    """cluster, merged_into, dropped: pairs of clusters of one consensus that are one but for a single read.

    members: consensus, breakpoint, cluster, reverse, read, start, end. Two clusters of a strand are one if exactly one of
    their reads lies on the wrong side of the breakpoint, their common span exceeds max_is with it and does not without it.
    """

    def scan(rows: list[dict]) -> list[dict]:
        by: dict = {}
        for r in rows:
            by.setdefault((r["cluster"], r["reverse"]), {})[r["read"]] = (r["start"], r["end"])
        keys, point, out, used = sorted(by), rows[0]["breakpoint"], [], set()
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if a[1] != b[1] or a[0] == b[0]:
                    continue
                reads = by[a] | by[b]
                wrong = [k for k, (s, e) in reads.items() if (e <= point if a[1] else s >= point)]
                if len(wrong) != 1:
                    continue
                kept = [v for k, v in reads.items() if k != wrong[0]]
                width = lambda v: max(e for _, e in v) - min(s for s, _ in v)
                if not kept or width(reads.values()) <= max_is or width(kept) > max_is:
                    continue
                if used & {a[0], b[0]}:
                    raise ValueError(f"clusters of breakpoint {point} have more than one partner")
                used |= {a[0], b[0]}
                out.append({"cluster": b[0], "merged_into": a[0], "dropped": wrong[0]})
        return out

    kind = members.schema["cluster"].dataType.simpleString()
    return ordered.per_group(members, ["consensus"], ["cluster", "read"], scan, f"cluster {kind}, merged_into {kind}, dropped string")


def refine_deletions(deletions: DataFrame, junction_reads: DataFrame, least: int = 2, min_size: int = 50) -> DataFrame:
    """Imprecise deletions (id, start, end, imprecise) made exact where just one junction has at least ``least`` reads.

    junction_reads: id, qname, start, end, ins_seq, leftmost forms of what split reads near the ends say.
    """
    n = junction_reads.where(F.col("end") - F.col("start") >= min_size).groupBy("id", "start", "end", "ins_seq").agg(F.count_distinct("qname").alias("n")).where(F.col("n") >= least)
    one = n.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.first(F.struct("start", "end", "ins_seq")).alias("j")).where("k = 1")
    j = deletions.join(one, "id", "left")
    found = F.col("imprecise") & F.col("j").isNotNull()
    more = {"start": F.when(found, F.col("j.start")).otherwise(F.col("start")), "end": F.when(found, F.col("j.end")).otherwise(F.col("end")), "ins_seq": F.when(found, F.col("j.ins_seq")).otherwise(F.col("ins_seq") if "ins_seq" in deletions.columns else F.lit("")), "imprecise": F.col("imprecise") & ~found, "original_range": F.when(found, F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))}
    return j.select(*[more.pop(c, F.col(c)).alias(c) for c in deletions.columns], *[v.alias(k) for k, v in more.items() if k in ("ins_seq", "original_range")])


