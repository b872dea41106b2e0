"""Variant tables: normalisation, identity, conflicts, reconciliation, comparison of call sets, cohorts.

A variant row has id, chr, start, end (0-based; start is the base before the change), svtype, ins_seq, gt array<int>, epr
double, imprecise boolean, filters array<string>, and for haplotypes aux_snps and aux_indels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import align, predicates, sequence
from ..functions.types import SIMPLE, struct
from ..operators import graph, ordered, ranges, sets
from . import likeness


def normalise(variants: DataFrame, contigs: DataFrame, flank: int = 2000) -> DataFrame:
    """variants with start, end and ins_seq in their leftmost form after dropping shared ends; imprecise ones stay.

    contigs (chr, seq). Only flank bases around a variant travel with it; a change that shifts further stays at the
    flank's edge, which is told in the column at_edge.
    """
    lo = F.greatest(F.col("start") - flank, F.lit(0))
    near = F.substr(F.col("seq"), (lo + 1).cast("int"), (F.col("end") - lo + 2).cast("int"))
    rows = variants.join(contigs, "chr").withColumns({"_lo": lo, "_ref": near}).drop("seq")
    moved = _normalise("_ref", F.col("start") - F.col("_lo"), F.col("end") - F.col("_lo"), F.coalesce("ins_seq", F.lit("")))
    exact = ~F.coalesce("imprecise", F.lit(False)) & F.col("svtype").isin("DEL", "INS", "DUP") & ~F.coalesce("ins_seq", F.lit("")).contains("-")
    out = rows.withColumn("_m", F.when(exact, moved))
    pick = lambda c, v: F.when(F.col("_m").isNotNull(), v).otherwise(F.col(c)).alias(c)
    kept = [c for c in variants.columns if c not in ("start", "end", "ins_seq")]
    return out.select(*kept, pick("start", F.col("_m.start") + F.col("_lo")), pick("end", F.col("_m.end") + F.col("_lo")), pick("ins_seq", F.col("_m.ins")), (F.coalesce(F.col("_m.start") == 0, F.lit(False)) & (F.col("_lo") > 0)).alias("at_edge"))


@F.pandas_udf(struct("start long, end long, ins string"))
def _normalise(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for ref, start, end, ins in batches:
        rows = [sequence.left_align(r, *sequence.trim_shared(r, int(s), int(e), i)) for r, s, e, i in zip(ref, start, end, ins)]
        yield pd.DataFrame(rows, columns=["start", "end", "ins"])


def unique_haplotypes(variants: DataFrame, priority: Column) -> DataFrame:
    """One variant of each hpid: the first by priority, then id."""
    return sets.keep_best(variants, ["chr", "hpid"], [priority, "id"])


def drop_contained(haplotypes: DataFrame, width: int = 2000) -> DataFrame:
    """Haplotypes but those whose remapped range lies in that of a longer one that has the same atoms within it.

    Columns: id, chr, lo, hi, priority, atoms array<struct<pos:long,key:string>>.
    """
    a = haplotypes.select("chr", *[F.col(c).alias(f"a_{c}") for c in ("id", "lo", "hi", "priority", "atoms")])
    b = haplotypes.select("chr", *[F.col(c).alias(f"b_{c}") for c in ("id", "lo", "hi", "priority", "atoms")])
    met = ranges.contains_join(a, b, ["chr"], ("a_lo", "a_hi"), ("b_lo", "b_hi"), width).where("a_id <> b_id")
    longer = F.struct(F.col("a_hi") - F.col("a_lo"), -F.col("a_priority"), F.col("b_id")) > F.struct(F.col("b_hi") - F.col("b_lo"), -F.col("b_priority"), F.col("a_id"))
    within = F.filter("a_atoms", lambda x: x["pos"].between(F.col("b_lo"), F.col("b_hi")))
    same = sets.same_atoms(F.transform(within, lambda x: x["key"]), F.transform("b_atoms", lambda x: x["key"]))
    lost = met.where(longer & same).select(F.col("b_id").alias("id")).distinct()
    return haplotypes.join(lost, "id", "left_anti")


def expand_atoms(variants: DataFrame) -> DataFrame:
    """Each further indel of a haplotype as a variant of its own, whose context is the main variant and its siblings."""
    main = F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.coalesce("ins_seq", F.lit("")).alias("ins_seq"))
    every = F.concat(F.array(main), F.coalesce("aux_indels", F.array().cast("array<struct<start:long,end:long,ins_seq:string>>")))
    rows = variants.withColumn("_all", every).select("*", F.posexplode("_all").alias("_k", "_x"))
    kind = F.when(F.col("_k") == 0, F.col("svtype")).when(F.col("_x.end") > F.col("_x.start"), "DEL").otherwise("INS")
    context = F.filter("_all", lambda y: y != F.col("_x"))
    new = {"id": F.when(F.col("_k") == 0, F.col("id")).otherwise(F.concat_ws("_", "id", F.lit("AUX"), "_k")), "svtype": kind, "start": F.col("_x.start"), "end": F.col("_x.end"), "ins_seq": F.col("_x.ins_seq"), "aux_indels": context}
    return rows.withColumns(new).select(*variants.columns)


def valid_haplotype(indels: str = "aux_indels", snps: str = "aux_snps") -> Column:
    """No two indels overlap, and no place has two mismatches."""
    s = F.array_sort(indels)
    apart = F.forall(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.coalesce(F.get(s, i)["start"] >= F.get(s, i - 1)["end"], F.lit(True)))
    places = F.transform(snps, lambda x: x["pos"])
    return F.coalesce(apart, F.lit(True)) & F.coalesce(F.size(F.array_distinct(places)) == F.size(places), F.lit(True))


def split_insertions(variants: DataFrame, contigs: DataFrame, share: float = 0.8) -> DataFrame:
    """variants and, for insertions that repeat the reference beside them, a duplication twin with id and "_DUP"."""
    near = variants.where((F.col("svtype") == "INS") & ~F.col("ins_seq").contains("-") & (F.length("ins_seq") > 0)).join(contigs, "chr")
    n = F.length("ins_seq")
    lo = F.greatest(F.col("start") + 1 - n, F.lit(0))
    found = near.withColumns({"_lo": lo, "_r": F.substr("seq", (lo + 1).cast("int"), (2 * n).cast("int"))}).drop("seq")
    hit = found.withColumn("_x", _repeats("ins_seq", "_r", F.col("start") - F.col("_lo"), F.lit(share))).where("_x.start is not null")
    twin = hit.withColumns({"id": F.concat("id", F.lit("_DUP")), "svtype": F.lit("DUP"), "start": F.col("_lo") + F.col("_x.start") - 1, "end": F.col("_lo") + F.col("_x.end") - 1, "ins_seq": F.lit("")})
    return variants.unionByName(twin.select(*variants.columns))


@F.pandas_udf(struct("start long, end long"))
def _repeats(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for ins, ref, start, share in batches:
        rows = [align.insertion_repeats_reference(i, r, int(s), x) or (None, None) for i, r, s, x in zip(ins, ref, start, share)]
        yield pd.DataFrame(rows, columns=["start", "end"], dtype="Int64")


def reconcile(base: DataFrame, called: DataFrame) -> DataFrame:
    """base with genotype and epr of its best call: by id without _DUP, the highest epr; without a call ./. and null."""
    c = called.withColumn("id", sequence.strip_twin(F.col("id")))
    best = ordered.ranked(c, ["id"], [F.desc_nulls_last("epr"), "svtype"]).select("id", F.col("gt").alias("_gt"), F.col("epr").alias("_epr"))
    none = F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))
    return base.drop("gt", "epr").join(best, "id", "left").withColumns({"gt": F.coalesce("_gt", none), "epr": F.col("_epr")}).drop("_gt", "_epr")


def apply_predictions(variants: DataFrame, predictions: DataFrame) -> DataFrame:
    """variants with gt, epr, hopr and cnu of predictions (id, epr, hopr, cnu): present above 0.5, then homozygous above 0.5."""
    j = variants.drop("gt", "epr", "hopr", "cnu").join(predictions, "id", "left")
    gt = F.when(F.col("epr").isNull(), F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).when(F.col("epr") <= 0.5, F.array(F.lit(0), F.lit(0))).when(F.col("hopr") > 0.5, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    return j.withColumn("gt", gt)


def resolve_overlaps(variants: DataFrame, haploid: Column | None = None) -> DataFrame:
    """variants with gt settled where calls overlap: by falling epr at most two alternative alleles a place (one if haploid).

    The first of two equal hets becomes 1/1 and the second 0/0, unless the first has erefa = 1. A homozygous call gives
    way to a different one if that one's epr exceeds the first's hopr: both become 0/1, else the second 0/0. Calls that
    find no room become 0/0. Rows are read by session of overlapping calls.
    """
    rows = variants.withColumns({"_key": predicates.unique_key(), "_cap": F.lit(2) if haploid is None else F.when(haploid, 1).otherwise(2), "_alts": predicates.alt_alleles()})

    def scan(start, end, key, cap, alts, epr, hopr, erefa) -> list[int]:
        alts = list(alts)
        taken = ordered.Tracks()
        for i in range(len(start)):
            if not alts[i]:
                continue
            # Calls that have found room leave little for others, so few of them meet anywhere.
            over = taken.meet(start[i], end[i])
            for j in over:
                if not alts[i]:
                    break
                if key[j] == key[i]:
                    alts[i] = 0
                    if erefa[j] != 1:
                        alts[j] = 2
                elif alts[j] >= 2:
                    if (epr[i] or 0) > (hopr[j] if hopr[j] is not None else 1):
                        alts[i] = alts[j] = 1
                    else:
                        alts[i] = 0
            if alts[i]:
                edges = sorted([(max(start[j], start[i]), 0, alts[j]) for j in over if alts[j]] + [(min(end[j], end[i]), 1, alts[j]) for j in over if alts[j]])
                depth = most = 0
                for _, closing, n in edges:
                    depth += -n if closing else n
                    most = max(most, depth)
                if most >= cap[i]:
                    alts[i] = 0
                elif most + alts[i] > cap[i]:
                    alts[i] = cap[i] - most
            if alts[i]:
                taken.add(start[i], end[i], i)
        return alts

    use = ["start", "end", "_key", "_cap", "_alts", "epr", "hopr", "erefa"]
    settled = ordered.per_session(rows, ["chr"], "start", "end", 0, [F.desc_nulls_last("epr"), "_key", "id"], use, scan, "_settled", pa.int64())
    gt = F.when(F.col("_settled") >= 2, F.array(F.lit(1), F.lit(1))).when(F.col("_settled") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(0)))
    return settled.withColumn("gt", F.when(F.col("_alts") == F.col("_settled"), F.col("gt")).otherwise(gt)).select(*variants.columns)


def split_small(variants: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Small and structural variants."""
    small = F.coalesce(predicates.is_small(limit), F.lit(False))
    return variants.where(small), variants.where(~small)


def drop_identical_failed(variants: DataFrame) -> DataFrame:
    """variants but failed ones of which an identical one passes."""
    rows = variants.withColumn("_k", predicates.unique_key()).withColumn("_ok", predicates.is_pass())
    good = rows.where("_ok").select("_k").distinct()
    return rows.where("_ok").unionByName(rows.where("not _ok").join(good, "_k", "left_anti").select(*rows.columns)).drop("_k", "_ok")


@dataclass(frozen=True)
class Match:
    """How far two variants may differ; the second of two values holds if either is imprecise."""

    distance: tuple[int, int] = (100, 500)
    overlap: tuple[float, float] = (0.8, 0.5)
    length: tuple[int, int] = (100, 500)
    ratio: tuple[float, float] = (0.8, 0.8)
    in_repeat: int = 1000


def distance(a: str, b: str) -> Column:
    """Larger distance of the two ends; the smaller one between a duplication and an insertion."""
    s, e = F.abs(F.col(f"{a}.start") - F.col(f"{b}.start")), F.abs(F.col(f"{a}.end") - F.col(f"{b}.end"))
    return F.when(F.col(f"{a}.svtype") != F.col(f"{b}.svtype"), F.least(s, e)).otherwise(F.greatest(s, e))


def shared_part(a: str, b: str) -> Column:
    """Overlap over the shorter span; 1 for two insertions and for empty spans."""
    la, lb = (F.col(f"{x}.end") - F.col(f"{x}.start") for x in (a, b))
    both = F.least(F.col(f"{a}.end"), F.col(f"{b}.end")) - F.greatest(F.col(f"{a}.start"), F.col(f"{b}.start"))
    point = ((F.col(f"{a}.svtype") == "INS") & (F.col(f"{b}.svtype") == "INS")) | (F.least(la, lb) <= 0)
    return F.when(point, 1.0).otherwise(F.greatest(both, F.lit(0)) / F.least(la, lb))


def length_of(v: str) -> Column:
    n = F.length(F.coalesce(F.col(f"{v}.ins_seq"), F.lit("")))
    return F.when(F.col(f"{v}.svtype") == "INS", n).otherwise(F.greatest(F.col(f"{v}.end") - F.col(f"{v}.start"), n))


def incomplete(v: str) -> Column:
    return F.coalesce(F.col(f"{v}.ins_seq").contains("-"), F.lit(False))


def compatible(a: str, b: str, m: Match, repeat: Column | None = None) -> Column:
    """Types, places, spans and lengths agree; in a common repeat places may differ more and spans don't count."""
    loose = F.coalesce(F.col(f"{a}.imprecise"), F.lit(False)) | F.coalesce(F.col(f"{b}.imprecise"), F.lit(False))
    pick = lambda pair: F.when(loose, pair[1]).otherwise(pair[0])
    ta, tb = F.col(f"{a}.svtype"), F.col(f"{b}.svtype")
    types = (ta == tb) | (ta.isin("DUP", "INS") & tb.isin("DUP", "INS"))
    la, lb = length_of(a), length_of(b)
    # What is known of an incomplete insertion is a lower bound of its length.
    unknown = incomplete(a) | incomplete(b)
    lengths = unknown | ((F.abs(la - lb) <= pick(m.length)) & (F.least(la, lb) >= pick(m.ratio) * F.greatest(la, lb)))
    near = (distance(a, b) <= pick(m.distance)) & (shared_part(a, b) >= pick(m.overlap))
    return types & lengths & (near if repeat is None else near | (repeat & (distance(a, b) <= m.in_repeat)))


def same_genotype(a: str, b: str) -> Column:
    """The ranges of alternative alleles that the calls allow overlap; a missing allele can be either."""
    known = lambda v: F.size(F.filter(F.col(f"{v}.gt"), lambda x: x > 0))
    open_ = lambda v: F.size(F.filter(F.col(f"{v}.gt"), lambda x: x.isNull()))
    return (known(a) <= known(b) + open_(b)) & (known(b) <= known(a) + open_(a))


@F.pandas_udf(SIMPLE["double"])
def insertion_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the bases that align over both lengths."""

    def one(x: str | None, y: str | None) -> float | None:
        if not x or not y:
            return None
        found = align.with_shortcut(x, y)
        if found is None:
            return 0.0
        i, j, same = found.q_start, found.r_start, 0
        for op, n in found.ops:
            if op == "M":
                same += sum(x[i + k] == y[j + k] for k in range(n))
                i, j = i + n, j + n
            elif op == "I":
                i += n
            else:
                j += n
        return 2 * same / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)])


#: The columns of a variant that comparisons read.
COMPARED = ("id", "sample", "chr", "start", "end", "svtype", "ins_seq", "imprecise", "gt", "epr", "consistent_reads", "alt_reads", "ext_alt_score")


def candidate_pairs(benchmark: DataFrame, called: DataFrame, m: Match, repeats: DataFrame | None = None, similarity: float = 0.0, width: int | None = None) -> DataFrame:
    """Pairs (a: benchmark, b: called) that are compatible, with their score. Cheap conditions come before alignment.

    width of the join's bins: by default twice the widest reach, so that dense contigs have few candidates.
    """
    reach = max(*m.distance, m.in_repeat if repeats is not None else 0)
    width = width or 2 * reach
    # Only what is compared travels: long texts beside it stay where they are.
    side = lambda df, n, pad: df.select("chr", F.struct(*[c for c in df.columns if c in COMPARED]).alias(n), (F.col("start") - pad).alias(f"{n}_lo"), (F.col("end") + pad).alias(f"{n}_hi"))
    # An end within reach of the other's means that one, widened by reach, meets the other.
    a, b = side(benchmark, "a", reach), side(called, "b", 0)
    repeat = None
    if repeats is not None:
        spans = repeats.select("chr", F.col("start").alias("r_lo"), F.col("end").alias("r_hi"))
        inside = ranges.contains_join(spans, a.select("chr", "a", F.col("a.start").alias("_s"), F.col("a.end").alias("_e")), ["chr"], ("r_lo", "r_hi"), ("_s", "_e"), width, slack=10)
        marked = inside.groupBy(F.col("a.id").alias("_id")).agg(F.min("r_lo").alias("_rlo"), F.max("r_hi").alias("_rhi"))
        a = a.join(marked, F.col("a.id") == F.col("_id"), "left").drop("_id")
        repeat = F.coalesce((F.col("b.start") <= F.col("_rhi")) & (F.col("b.end") >= F.col("_rlo")), F.lit(False))
    met = ranges.range_join(a, b, ["chr"], ("a_lo", "a_hi"), ("b_lo", "b_hi"), width, compatible("a", "b", m, repeat))
    d, diff = distance("a", "b"), F.abs(length_of("a") - length_of("b"))
    out = met.select("chr", "a", "b", d.alias("distance"), diff.alias("length_difference"))
    both = (F.col("a.svtype") == "INS") & (F.col("b.svtype") == "INS") & ~incomplete("a") & ~incomplete("b")
    close = F.when(both & (F.col("a.ins_seq") == F.col("b.ins_seq")), 1.0).when(both, insertion_similarity(F.col("a.ins_seq"), F.col("b.ins_seq")))
    scored = out.withColumn("similarity", close if similarity > 0 else F.lit(None).cast("double"))
    kept = scored.where(F.col("similarity").isNull() | (F.col("similarity") >= similarity))
    return kept.withColumn("score", -F.col("length_difference") - F.log(F.col("distance") + 1) + 100 * F.coalesce("similarity", F.lit(0.0)))


def match_order(columns: Sequence[str], repeat: Column | None = None) -> Column:
    """The order in which matches are taken, best last: exact ones, then fewer missing alleles of the benchmark, then those not
    found by a repeat, then score, and of the call consistent reads, alternative reads and the score of its extended
    consensus. columns are those of the call's struct; what it lacks counts as equal."""
    exact = (F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end")) & (F.col("a.svtype") == F.col("b.svtype")) & F.col("a.ins_seq").eqNullSafe(F.col("b.ins_seq"))
    missing = F.size(F.filter("a.gt", lambda x: x.isNull()))
    more = [F.coalesce(F.col(f"b.{c}").cast("double"), F.lit(0.0)).alias(c) for c in ("consistent_reads", "alt_reads", "ext_alt_score") if c in columns]
    rep = F.lit(False) if repeat is None else F.coalesce(repeat, F.lit(False))
    return F.struct(exact.alias("exact"), (-F.greatest(missing, F.lit(0))).alias("complete"), (~rep).alias("unique"), F.col("score").alias("score"), same_genotype("a", "b").cast("int").alias("same_gt"), (-F.col("distance")).alias("near"), *more)


def optimal_matches(pairs: DataFrame) -> DataFrame:
    """pairs but those that another pair of the same call beats in exactness, missing alleles, repeat or score."""
    o = match_order([])
    best = F.rank().over(Window.partitionBy("b.id").orderBy(F.desc(F.struct(o["exact"], o["complete"], o["unique"], o["score"]))))
    return pairs.withColumn("_rank", best).where("_rank = 1").drop("_rank")


def best_matches(pairs: DataFrame, capacity: int = 1) -> DataFrame:
    """benchmark_id, called_id: pairs taken by match_order, then by ids, while both sides have room."""
    call = pairs.schema["b"].dataType.names
    ranked = pairs.select("chr", F.col("a.id").alias("benchmark_id"), F.col("b.id").alias("called_id"), match_order(call).alias("_o"))
    taken = graph.greedy_matching(ranked, ["chr"], "benchmark_id", "called_id", "_o", capacity, capacity, descending=True)
    return taken.where("accepted").select("benchmark_id", "called_id")


def output_order() -> list[Column]:
    """The order of records in files: place, end, type, facing of breakends, sequence, source, filters (passing first), haplotype."""
    failed = F.when(predicates.is_pass(), F.lit("")).otherwise(F.concat(F.lit("1"), F.array_join("filters", ";")))
    return [F.col("start"), F.col("end"), F.col("svtype"), F.coalesce("ins_seq", F.lit("")), F.coalesce("source", F.lit("")), failed, F.coalesce("hpid", F.lit(0)), F.col("id")]


def sessions_of(variants: DataFrame, m: Match, order: Sequence[str], use: Sequence[str], scan, name: str, kind: pa.DataType) -> DataFrame:
    """variants with a column that scan gives for each session, which no compatible pair crosses; chr, start, end not null."""
    ends = {"_lo": F.least("start", "end"), "_hi": F.greatest("start", "end")}
    return ordered.per_session(variants.withColumns(ends), ["chr"], "_lo", "_hi", max(m.distance), order, use, scan, name, kind).drop("_lo", "_hi")


def _hits(benchmark: DataFrame, called: DataFrame, m: Match) -> DataFrame:
    """side (0: benchmark), svtype and hit of every variant: best_matches for one to one, by session instead of by pair."""
    more = [c for c in ("consistent_reads", "alt_reads", "ext_alt_score") if c in called.columns]

    def side(df: DataFrame, n: int) -> DataFrame:
        known, missing = F.size(F.filter("gt", lambda x: x > 0)), F.size(F.filter("gt", lambda x: x.isNull()))
        counts = [F.when(F.col("gt").isNotNull(), c).alias(k) for k, c in (("known", known), ("missing", missing))]
        told = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if n else F.lit(0.0).alias(c) for c in more]
        return df.select(F.lit(n).alias("side"), "id", "chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "svtype", "ins_seq", F.coalesce("imprecise", F.lit(False)).alias("imprecise"), *counts, *told)

    rows = side(benchmark, 0).unionByName(side(called, 1))
    usable = F.lit(True)
    for c in ("id", "chr", "start", "end", "svtype"):
        usable &= F.col(c).isNotNull()
    use = ["side", "id", "start", "end", "svtype", "ins_seq", "imprecise", "known", "missing", *more]
    found = sessions_of(rows.where(usable), m, ["side", "id"], use, partial(likeness.match, m), "hit", pa.bool_())
    return found.select("side", "svtype", "hit").union(rows.where(~usable).select("side", "svtype", F.lit(False)))


def compare(benchmark: DataFrame, called: DataFrame, m: Match = Match(), repeats: DataFrame | None = None, capacity: int = 1) -> DataFrame:
    """Per type: tp of both sides, fn, fp, recall, precision and F1.

    One to one without repeats, sessions of calls are matched form by form and no pair is listed; else all pairs are.
    """
    if repeats is None and capacity == 1:
        n = {"b_tp": (0, "hit"), "b_miss": (0, "not hit"), "c_tp": (1, "hit"), "c_miss": (1, "not hit")}
        both = _hits(benchmark, called, m).groupBy("svtype").agg(*[F.count_if((F.col("side") == k) & F.expr(h)).alias(c) for c, (k, h) in n.items()])
    else:
        found = best_matches(candidate_pairs(benchmark, called, m, repeats), capacity)
        side = lambda df, key, name: df.join(found.select(F.col(key).alias("id")).distinct().withColumn("_hit", F.lit(True)), "id", "left").groupBy("svtype").agg(F.count_if(F.col("_hit")).alias(f"{name}_tp"), F.count_if(F.col("_hit").isNull()).alias(f"{name}_miss"))
        both = side(benchmark, "benchmark_id", "b").join(side(called, "called_id", "c"), "svtype", "full").na.fill(0)
    out = both.select("svtype", "b_tp", F.col("b_miss").alias("fn"), "c_tp", F.col("c_miss").alias("fp"))
    recall, precision = F.try_divide("b_tp", F.col("b_tp") + F.col("fn")), F.try_divide("c_tp", F.col("c_tp") + F.col("fp"))
    return out.withColumns({"recall": recall, "precision": precision}).withColumn("f1", F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def deduplicate(variants: DataFrame, m: Match = Match()) -> DataFrame:
    """variants without those that match a better one: precise before imprecise, then epr; ties keep both."""
    rows = variants.select("id", "chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "svtype", F.coalesce("ins_seq", F.lit("")).alias("ins_seq"), F.coalesce("imprecise", F.lit(False)).alias("imprecise"), "epr")
    use = ["id", "start", "end", "svtype", "ins_seq", "imprecise", "epr"]
    found = sessions_of(rows.dropna(subset=["id", "chr", "start", "end", "svtype"]), m, ["start"], use, partial(likeness.beaten, m), "lost", pa.bool_())
    return variants.join(found.where("lost").select("id").distinct(), "id", "left_anti")


def cohort(variants: DataFrame, samples: list[str], gap: int = 500, m: Match = Match()) -> DataFrame:
    """One row a cluster of compatible calls of a cohort: representative, n_samples, n_calls and a genotype a sample.

    variants have sample. Calls without an alternative allele, of other types or failed are left out. Clusters are cliques
    within sessions of starts at most gap apart; the representative is the most frequent exact form, then the one with the
    higher epr.
    """
    keep = variants.where((predicates.alt_alleles() >= 1) & predicates.supported_type() & predicates.is_pass())
    rows = keep.select("sample", "id", "chr", "start", "end", "svtype", F.coalesce("ins_seq", F.lit("")).alias("ins_seq"), F.coalesce("imprecise", F.lit(False)).alias("imprecise"), "epr", F.array_join(F.transform("gt", lambda x: F.coalesce(x.cast("string"), F.lit("."))), "/").alias("gt"))
    use = ["start", "end", "svtype", "ins_seq", "imprecise"]
    cl = ordered.per_session(rows, ["chr"], "start", "start", gap, ["start", "end", "svtype", "sample", "id"], use, partial(likeness.cliques, m, gap), "clique", pa.int64())
    # A clique's number holds within its session; its first row names it over all.
    cl = ranges.sessions(cl, ["chr"], "start", gap)
    key = ["chr", "session", "clique"]
    form = F.concat_ws(":", "start", "end", "svtype", "ins_seq")
    freq = cl.groupBy(*key, form.alias("_f")).agg(F.count_if(~F.col("imprecise") & ~F.col("ins_seq").contains("-")).alias("_p"), F.count(F.lit(1)).alias("_n"), F.max("epr").alias("_e"))
    best = ordered.ranked(freq, key, [F.desc("_p"), F.desc("_n"), F.desc_nulls_last("_e"), "_f"]).select(*key, "_f")
    head = ordered.ranked(cl.withColumn("_f", form).join(best, [*key, "_f"]), key, ["sample", "id"]).select(*key, "id", "start", "end", "svtype", "ins_seq")
    wide = cl.groupBy(*key).agg(F.count_distinct("sample").alias("n_samples"), F.count(F.lit(1)).alias("n_calls"), *[F.min(F.when(F.col("sample") == s, F.col("gt"))).alias(s) for s in samples])
    return head.join(wide, key).drop("session", "clique")


def _compatible(a: dict, b: dict, m: Match) -> bool:
    """compatible() on two rows, with the similarity of complete insertions."""
    if a["svtype"] != b["svtype"] and {a["svtype"], b["svtype"]} != {"DUP", "INS"}:
        return False
    k = int(a["imprecise"] or b["imprecise"])
    s, e = abs(a["start"] - b["start"]), abs(a["end"] - b["end"])
    if (max(s, e) if a["svtype"] == b["svtype"] else min(s, e)) > m.distance[k]:
        return False
    la, lb = (x["end"] - x["start"] for x in (a, b))
    if not (a["svtype"] == b["svtype"] == "INS") and min(la, lb) > 0:
        if max(0, min(a["end"], b["end"]) - max(a["start"], b["start"])) / min(la, lb) < m.overlap[k]:
            return False
    if "-" in a["ins_seq"] or "-" in b["ins_seq"]:
        return True
    na, nb = (len(x["ins_seq"]) if x["svtype"] == "INS" else max(x["end"] - x["start"], len(x["ins_seq"])) for x in (a, b))
    return abs(na - nb) <= m.length[k] and min(na, nb) >= m.ratio[k] * max(na, nb)


def copy_number_labels(calls: DataFrame, truth: DataFrame, width: int = 10_000) -> DataFrame:
    """id, cnu: 1 if the alternative alleles of contained truth variants make up a call's span, 0 if not, null without any.

    truth: chr, start, end, alts; calls: id, chr, start, end.
    """
    c = calls.select("id", "chr", F.col("start").alias("c_lo"), F.col("end").alias("c_hi"))
    t = truth.select("chr", F.col("start").alias("t_lo"), F.col("end").alias("t_hi"), "alts")
    met = ranges.contains_join(c, t, ["chr"], ("c_lo", "c_hi"), ("t_lo", "t_hi"), width)
    total = met.groupBy("id").agg(F.sum((F.col("t_hi") - F.col("t_lo")) * F.col("alts")).alias("_t"), F.first(F.col("c_hi") - F.col("c_lo")).alias("_l"))
    return calls.select("id").join(total.select("id", (F.col("_t") >= F.col("_l")).cast("int").alias("cnu")), "id", "left")


SCHEMA = StructType([StructField("benchmark_id", StringType()), StructField("called_id", StringType())])
