"""The query lifecycle: from alignments to calls, and from calls to genotypes. Each stage is a plan; a run is one DAG.

Stages that several others read are written once, so none is computed twice and lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import junctions, predicates
from ..operators import ranges
from ..sources import vcf
from ..tables import Scratch
from . import consensus, reads as read_plans, variants


@dataclass(frozen=True)
class Config:
    """Settings of a run; those of the command line have the same names."""

    seed: int = 0
    max_seq_error: float = 0.04
    min_sv_size: int = 50
    min_clip_len: int = 10
    min_diff_hsr: int = 2
    coverage_window_size: int = 1000
    min_stable_mapq: int = 20
    high_confidence_mapq: int = 60
    per_contig_stats: bool = False
    single_pass: bool = False
    write_aux_snp: bool = False
    haploid_contigs: str = ""
    max_trans_size: int = 10_000
    samplename: str = ""
    read_len: int | None = None
    min_is: int | None = None
    max_is: int | None = None
    max_depth: int | None = None


def measured(reads: DataFrame, config: Config) -> Config:
    """config with read length, insert sizes and depth taken from the reads where they aren't given."""
    proper = reads.where(predicates.flag(predicates.PROPER) & predicates.is_primary() & predicates.same_contig() & (F.col("isize") > 0))
    sizes = read_plans.stats.trimmed_moments(proper.select("isize"), [], "isize").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n")).first()
    longest = reads.where(predicates.is_primary()).agg(F.max(F.length("seq"))).first()[0] or 0
    deepest = read_plans.depth_windows(reads, config.coverage_window_size).agg(F.max("max_depth")).first()[0] or 0
    lo, hi = (int(sizes["lo"]), int(sizes["hi"])) if sizes["n"] else (0, 2 * longest)
    pick = lambda given, found: found if given is None else given
    return replace(config, read_len=pick(config.read_len, longest), min_is=pick(config.min_is, max(0, lo)), max_is=pick(config.max_is, max(hi, longest)), max_depth=pick(config.max_depth, max(1, deepest)))


CHANGE = StructType([StructField("svtype", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("ins_seq", StringType())])


def _junctions(config: Config):
    reach = max(1, config.read_len - 2 * config.min_clip_len)

    @F.pandas_udf(ArrayType(CHANGE))
    def told(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for seqs, refs, froms, l0, l1, r0, r1 in batches:
            out = []
            for s, ref, at, a, b, c, d in zip(seqs, refs, froms, l0, l1, r0, r1):
                found = junctions.junction_changes(s, ref, (a - at, b - at), (c - at, d - at), config.min_clip_len, config.min_sv_size, reach) if s and ref else []
                out.append([{"svtype": "DEL" if x.svtype == "RPL" else x.svtype, "start": x.start + at, "end": x.end + at, "ins_seq": x.ins} for x in found])
            yield pd.Series(out, dtype=object)

    return told


@F.pandas_udf(StringType())
def _joined(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Two consensuses as one sequence, if they overlap by least bases."""
    for a, qa, b, qb, least in batches:
        yield pd.Series([(j[0] if (j := junctions.join_consensuses(x, list(p), y, list(q), int(n))) else None) for x, p, y, q, n in zip(a, qa, b, qb, least)], dtype=object)


def consensus_variants(consensuses: DataFrame, contigs: DataFrame, config: Config) -> DataFrame:
    """Changes that consensuses tell, in pairs (a right- and a left-clipped one whose sequences overlap) and alone."""
    n = F.length("seq")
    right, left = consensuses.where("not left_clipped"), consensuses.where("left_clipped")
    r = right.select("contig", F.col("breakpoint").alias("at_r"), F.col("seq").alias("r_seq"), F.col("qual").alias("r_qual"), F.col("is_hidden").alias("r_hidden"), (F.col("breakpoint") - config.max_trans_size).alias("_lo"), (F.col("breakpoint") + config.max_trans_size).alias("_hi"))
    l = left.select("contig", F.col("breakpoint").alias("at_l"), F.col("seq").alias("l_seq"), F.col("qual").alias("l_qual"), F.col("is_hidden").alias("l_hidden"))
    met = ranges.point_join(l, r, ["contig"], "at_l", ("_lo", "_hi"), config.max_trans_size)
    both = met.withColumn("seq", _joined("r_seq", "r_qual", "l_seq", "l_qual", F.lit(2 * config.min_clip_len))).where("seq is not null")
    source = F.when(~F.col("r_hidden") & ~F.col("l_hidden"), "2SR").when(F.col("r_hidden") & F.col("l_hidden"), "2HSR").when(F.col("l_hidden"), "SR-HSR").otherwise("HSR-SR")
    pairs = both.select("contig", "seq", (F.col("at_r") - n).alias("l0"), (F.col("at_r") + n).alias("l1"), (F.col("at_l") - n).alias("r0"), (F.col("at_l") + n).alias("r1"), source.alias("source"))
    away = F.lit(config.max_is) + 2 * n
    side = F.when(F.col("is_hidden"), F.lit("1HSR_")).otherwise("1SR_")
    own0, own1 = F.col("start") - n, F.col("end") + n
    lone = consensuses.select("contig", "seq", F.when(F.col("left_clipped"), F.col("breakpoint") - away).otherwise(own0).alias("l0"), F.when(F.col("left_clipped"), F.col("breakpoint")).otherwise(own1).alias("l1"), F.when(F.col("left_clipped"), own0).otherwise(F.col("breakpoint")).alias("r0"), F.when(F.col("left_clipped"), own1).otherwise(F.col("breakpoint") + away).alias("r1"), F.concat(side, F.when(F.col("left_clipped"), "LC").otherwise("RC")).alias("source"))
    each = pairs.union(lone)
    lo, hi = F.greatest(F.lit(0), F.least("l0", "r0")), F.greatest("l1", "r1")
    near = each.join(contigs, "contig").select("contig", each["seq"], "source", "l0", "l1", "r0", "r1", lo.alias("_lo"), F.substr(contigs["seq"], (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_ref"))
    told = near.select("contig", "source", F.explode(_junctions(config)("seq", "_ref", "_lo", "l0", "l1", "r0", "r1")).alias("x"))
    return told.select(F.col("contig").alias("chr"), "x.start", "x.end", "x.svtype", F.col("x.ins_seq"), "source", F.lit(False).alias("imprecise"))


def pair_variants(reads: DataFrame, config: Config) -> DataFrame:
    """Imprecise deletions of long pairs and duplications of outward ones, by clusters of their anchors."""
    least = max(3, (config.max_depth + 5) // 10)
    most = max(least, config.max_depth * config.max_is // max(1, config.read_len))
    out = None
    for kind, plan in (("long", read_plans.pair_deletions), ("outward", read_plans.pair_duplications)):
        found = plan(read_plans.clusters(read_plans.pair_anchors(reads, kind, config.min_is, config.max_is), config.max_is, most, least))
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("contig").alias("chr"), "start", "end", "svtype", F.lit("").alias("ins_seq"), F.lit("DP").alias("source"), "imprecise")


def call(reads: DataFrame, contigs: DataFrame, config: Config = Config()) -> tuple[DataFrame, Config]:
    """Candidate variants of alignments (sources.readers.READS) against contigs (contig, seq), and the settings used.

    Clipped and hidden split reads are built into consensuses, whose junctions are exact calls; discordant pairs that none
    explains are imprecise ones. All are brought to their leftmost form; of equal ones the most trusted source stays.
    """
    spark = reads.sparkSession
    scratch = Scratch(spark, "call")
    config = measured(reads, config)
    sorted_reads = read_plans.categorised(reads, config.min_is, config.max_is, config.min_stable_mapq, config.min_clip_len, config.min_diff_hsr, config.min_sv_size)
    split = consensus.clip_reads(sorted_reads.where(F.arrays_overlap("categories", F.array(F.lit("sr"), F.lit("hsr")))))
    built = consensus.build(split, contigs, 20 * config.max_depth, config.min_clip_len, config.min_diff_hsr, config.min_sv_size)
    clean = scratch.table(consensus.processed(scratch.table(built, "built"), contigs, config.read_len // 2, 8, config.min_clip_len, config.min_diff_hsr), "consensuses")
    exact = scratch.table(consensus_variants(clean, contigs, config), "exact")
    pairs = pair_variants(reads, config).withColumn("id", F.monotonically_increasing_id().cast("string"))
    pairs = scratch.table(pairs.withColumnRenamed("chr", "contig"), "pairs")
    left = read_plans.drop_explained(pairs, exact.withColumnRenamed("chr", "contig"), config.max_is).drop("id").withColumnRenamed("contig", "chr")
    all_of = exact.unionByName(left).withColumns({"gt": F.array(F.lit(None).cast("int"), F.lit(None).cast("int")), "epr": F.lit(None).cast("double"), "filters": F.array().cast("array<string>")})
    placed = variants.normalise(all_of.withColumn("id", F.lit("")), contigs.withColumnRenamed("contig", "chr"))
    key = ["chr", "start", "end", "svtype", "ins_seq"]
    best = variants.sets.keep_best(placed.withColumn("_p", predicates.source_priority()), key, ["_p", "source"]).drop("_p")
    sized = best.where(F.abs(F.coalesce(predicates.svlen(), F.col("end") - F.col("start"))) >= config.min_sv_size)
    named = sized.withColumn("id", F.concat_ws("_", "svtype", F.col("chr"), (F.col("start") + 1).cast("string"), F.substr(F.md5(F.concat_ws(":", *key)), F.lit(1), F.lit(6))))
    return scratch.table(named.select("id", *key, "gt", "epr", "imprecise", "filters", "source"), "calls"), config


def genotype(calls: DataFrame, reads: DataFrame, contigs: DataFrame, config: Config = Config()) -> DataFrame:
    """calls with evidence counts, filters, epr and genotypes: reads are aligned to both alleles of each.

    Without a trained model epr is the share of alternative reads; those that equal both alleles count for neither.
    """
    config = measured(reads, config)
    evidence, deep = read_plans.read_evidence(reads, calls, contigs.withColumnRenamed("contig", "chr"), config.read_len, 4 * config.max_depth * config.read_len)
    told = read_plans.genotype(evidence, deep, calls.drop("gt"))
    share = F.try_divide("alt_reads", F.col("alt_reads") + F.col("ref_reads"))
    rules = ((F.col("too_deep"), "ANOMALOUS_FLANKING_DEPTH"), (F.col("alt_reads") < 2, "WEAK_SUPPORT"))
    return told.withColumn("epr", share).withColumn("filters", predicates.appended_filters(*rules))


def as_vcf(found: DataFrame, contigs: DataFrame, sample: str) -> tuple[list[str], DataFrame]:
    """Heading lines and records of variants, in the order of files."""
    lengths = [(r["contig"], r["n"]) for r in contigs.select("contig", F.length("seq").alias("n")).orderBy("contig").collect()]
    more = {c: F.lit(None).cast(t) for c, t in (("source", "string"), ("hpid", "long")) if c not in found.columns}
    j = found.withColumns(more).join(contigs.select(F.col("contig").alias("chr"), F.col("seq").alias("_seq")), "chr")
    base, removed = vcf.reference_bases(F.col("_seq"))
    order = variants.output_order()
    return vcf.header(lengths, [sample]), vcf.encode(j.orderBy("chr", *order), base, removed)


def run(spark: SparkSession, command: str, reads: DataFrame, contigs: DataFrame, config: Config, calls: DataFrame | None = None) -> DataFrame:
    """The genotyped variants of a run: ``call`` finds them first, ``genotype`` takes them."""
    if command == "call":
        calls, config = call(reads, contigs, config)
    elif command != "genotype" or calls is None:
        raise ValueError("the commands are call, and genotype with calls")
    return genotype(calls, reads, contigs, config)
