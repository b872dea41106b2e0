"""Inversions: from breakends, from replacements that are a reverse complement, and the filters that decide a genotype."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align, numeric, predicates, sequence
from ..functions.types import SIMPLE
from ..operators import graph, ordered, ranges


def pair_breakends(breakends: DataFrame, reach: int, width: int = 10_000) -> DataFrame:
    """Inversions of right-facing and left-facing breakends (id, chr, start, end, left_facing) at most reach apart.

    The nearest pairs first, each breakend once. Both say where the inverted part begins and ends; the inversion spans
    what either says, and inv_start, inv_end what both do.
    """
    side = lambda left, n: breakends.where(F.col("left_facing") if left else ~F.col("left_facing")).select("chr", *[F.col(c).alias(f"{n}_{c}") for c in ("id", "start", "end")])
    r, l = side(False, "r"), side(True, "l").withColumns({"lo": F.col("l_start") - reach, "hi": F.col("l_start") + reach})
    met = ranges.point_join(r, l, ["chr"], "r_start", ("lo", "hi"), width).where(F.abs(F.col("r_end") - F.col("l_end")) <= reach)
    cost = F.greatest(F.abs(F.col("r_start") - F.col("l_start")), F.abs(F.col("r_end") - F.col("l_end")))
    taken = graph.greedy_matching(met.drop("lo", "hi").withColumn("cost", cost), ["chr"], "r_id", "l_id", "cost").where("accepted")
    return taken.select("chr", F.concat_ws("+", "r_id", "l_id").alias("id"), F.least("r_start", "l_start").alias("start"), F.greatest("r_end", "l_end").alias("end"), F.lit("INV").alias("svtype"), F.greatest("r_start", "l_start").alias("inv_start"), F.least("r_end", "l_end").alias("inv_end"))


def outside(snps: str = "aux_snps") -> Column:
    """Further mismatches that lie in neither of a pair's uncertain ends."""
    inside = lambda p, a, b: p.between(F.least(a, b), F.greatest(a, b))
    return F.filter(snps, lambda x: ~inside(x["pos"], F.col("start"), F.col("inv_start")) & ~inside(x["pos"], F.col("inv_end"), F.col("end")))


def relabelled(variants: DataFrame, contigs: DataFrame, least: int = 50, cover: float = 0.75, share: float = 0.9) -> DataFrame:
    """variants where a replacement of about its own length that is the reverse complement of the removed part is an INV.

    An exact one keeps no inserted sequence. Only candidates by size meet their contig and are aligned.
    """
    span, n = F.col("end") - F.col("start"), F.length(F.coalesce("ins_seq", F.lit("")))
    fits = ~F.coalesce("imprecise", F.lit(False)) & F.col("svtype").isin("DEL", "INS", "RPL") & (span >= least) & (n >= least) & (F.abs(n - span) < least) & (n >= cover * span) & ~F.col("ins_seq").contains("-")
    rest, candidates = variants.where(~fits), variants.where(fits)
    near = candidates.join(contigs, "chr").withColumn("_r", F.substr("seq", (F.col("start") + 2).cast("int"), span.cast("int"))).drop("seq")
    scored = near.withColumn("_s", _score(sequence.reverse_complement(F.col("ins_seq")), "_r"))
    is_inv = F.col("_s") >= share * n
    exact = is_inv & (n == span) & (F.col("_s") == n)
    new = scored.withColumns({"svtype": F.when(is_inv, "INV").otherwise(F.col("svtype")), "ins_seq": F.when(exact, "").otherwise(F.col("ins_seq"))})
    return rest.unionByName(new.select(*variants.columns))


@F.pandas_udf(SIMPLE["int"])
def _score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([x.score if (x := align.with_shortcut(q, r)) else 0 for q, r in zip(a, b)], dtype="int32")


def judged(inversions: DataFrame, min_depth: int, max_depth: int, max_is: int, min_pairs: Column | int, high_mapq: int = 20) -> DataFrame:
    """inversions with filters and gt.

    Six conditions speak against the pairs, the reads, or both. It passes unless both kinds of evidence fail; the genotype
    follows the larger share of positive evidence, of each kind that of the worse breakpoint; a failed kind counts as 0.
    Columns: flank_depth_1/2, anchor_depth_1/2, alt_reads_1/2, ref_reads_1/2, alt_pairs_1/2, ref_pairs_1/2, pos_mq_1/2,
    neg_mq_1/2, anchor_length_1/2, alt_score_1/2, ref_score_1/2; a missing value of side 2 takes that of side 1.
    """
    c = lambda name, k: F.coalesce(F.col(f"{name}_{k}"), F.col(f"{name}_1"))
    either = lambda f: f(1) | f(2)
    depth = either(lambda k: ~c("flank_depth", k).between(min_depth, max_depth) | (c("anchor_depth", k) > max_depth))
    clips = either(lambda k: c("alt_reads", k) > max_depth)
    mapq = either(lambda k: (c("pos_mq", k) < high_mapq) | (c("neg_mq", k) < high_mapq))
    few = either(lambda k: c("alt_pairs", k) < (F.lit(min_pairs) if isinstance(min_pairs, int) else min_pairs) / 2)
    share = lambda kind, k: c(f"alt_{kind}", k) / F.greatest(F.lit(1), c(f"alt_{kind}", k) + c(f"ref_{kind}", k))
    low = either(lambda k: share("pairs", k) < 0.25)
    short = either(lambda k: c("anchor_length", k) < max_is / 2)
    score = either(lambda k: c("alt_score", k) <= c("ref_score", k))
    fail_pairs, fail_reads = depth | clips | mapq | few | low, depth | clips | short | score
    named = F.array_compact(F.array(*[F.when(x, n) for x, n in ((depth, "ANOMALOUS_FLANKING_DEPTH"), (clips, "ANOMALOUS_SC_NUMBER"), (mapq, "LOW_MAPQ_DISC_PAIRS"), (few, "NOT_ENOUGH_DISC_PAIRS"), (low, "LOW_PTN_RATIO"), (short, "SHORT_ANCHOR"), (score, "LOW_ALT_CONSENSUS_SCORE"))]))
    positive = F.greatest(F.when(fail_pairs, 0.0).otherwise(F.least(share("pairs", 1), share("pairs", 2))), F.when(fail_reads, 0.0).otherwise(F.least(share("reads", 1), share("reads", 2))))
    return inversions.withColumns({"filters": F.when(fail_pairs & fail_reads, named).otherwise(F.array(F.lit("PASS"))), "gt": predicates.inversion_call(positive)})


def flank_shift(depth_in: str, depth_out: str) -> Column:
    return numeric.ratio(F.col(depth_in), F.col(depth_out))
