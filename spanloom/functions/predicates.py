"""Conditions and derived columns of alignment and variant rows, one expression each.

Alignments have flag, contig, pos, mapq, cigar array<struct<op,len>>, mate_contig, mpos, isize, seq, nm, mq, mc; variants
have chr, start, end, svtype, ins_seq, filters array<string>, gt array<int>. All are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the alignment format's flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))
BASES = ("A", "C", "G", "T")


def flag(bit: int, column: str = "flag") -> Column:
    return F.col(column).bitwiseAND(F.lit(bit)) != 0


def is_unmapped() -> Column:
    return flag(UNMAPPED)


def is_mate_unmapped() -> Column:
    return flag(MATE_UNMAPPED)


def is_primary() -> Column:
    return ~flag(SECONDARY) & ~flag(SUPPLEMENTARY)


def same_contig() -> Column:
    return (F.col("contig") == F.col("mate_contig")) & ~is_unmapped() & ~is_mate_unmapped()


def same_strand() -> Column:
    return flag(REVERSE) == flag(MATE_REVERSE)


def discordant(far: int = 100_000) -> Column:
    return ~F.coalesce(same_contig(), F.lit(False)) | (F.abs("isize") > far) | (is_unmapped() != is_mate_unmapped())


def pair_kind(min_is: Column | int, max_is: Column | int) -> Column:
    """outward, short, proper or long for opposite strands on one contig, by the sign and size of isize; else null."""
    ahead = F.when(flag(REVERSE), -F.col("isize")).otherwise(F.col("isize"))
    size = F.abs("isize")
    kind = F.when(ahead < 0, "outward").when(size < min_is, "short").when(size > max_is, "long").otherwise("proper")
    return F.when(same_contig() & ~same_strand(), kind)


def _clip(end: int) -> Column:
    x = F.try_element_at("cigar", F.lit(end))
    return F.when(x["op"] == "S", x["len"]).otherwise(0)


def left_clip() -> Column:
    return _clip(1)


def right_clip() -> Column:
    return F.when(F.size("cigar") > 1, _clip(-1)).otherwise(0)


def reference_length(cigar: str = "cigar") -> Column:
    return F.aggregate(cigar, F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0))


def end() -> Column:
    return F.col("pos") + reference_length()


def unclipped_start() -> Column:
    return F.col("pos") - left_clip()


def unclipped_end() -> Column:
    return end() + right_clip()


def stable_end(min_mapq: int) -> Column:
    """Mapped well, not worse than the mate, and not clipped where sequencing began."""
    clip = F.when(flag(REVERSE), right_clip()).otherwise(left_clip())
    return ~is_unmapped() & (F.col("mapq") >= min_mapq) & (F.col("mapq") >= F.coalesce("mq", F.lit(0))) & (clip == 0)


def indel_ops() -> Column:
    """Struct of insertion and deletion operations and their bases."""
    n = lambda op: F.size(F.filter("cigar", lambda x: x["op"] == op))
    bases = lambda op: F.aggregate(F.filter("cigar", lambda x: x["op"] == op), F.lit(0), lambda a, x: a + x["len"])
    return F.struct(n("I").alias("ins_ops"), n("D").alias("del_ops"), bases("I").alias("ins_bases"), bases("D").alias("del_bases"))


def hidden_split(min_diff: int, min_size: int, min_mapq: int) -> Column:
    """Many differences though not clipped: mismatches plus indel operations, or a net indel of variant size."""
    x = indel_ops()
    indels = x["ins_bases"] + x["del_bases"]
    differences = F.col("nm") - indels + x["ins_ops"] + x["del_ops"]
    big = F.abs(x["del_bases"] - x["ins_bases"]) >= min_size
    clipped = (left_clip() > 0) | (right_clip() > 0)
    return ~is_unmapped() & ~clipped & ((differences >= min_diff) | big) & ~(discordant() & ~stable_end(min_mapq))


def mate_ops() -> Column:
    """The mate's CIGAR string as array<struct<len,op>>."""
    lengths, ops = F.regexp_extract_all("mc", F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), F.regexp_extract_all("mc", F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(lengths, ops, lambda n, op: F.struct(op.alias("op"), n.cast("int").alias("len")))


def mate_end() -> Column:
    return F.col("mpos") + F.aggregate(mate_ops(), F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0))


def mate_left_clip() -> Column:
    x = F.try_element_at(mate_ops(), F.lit(1))
    return F.when(x["op"] == "S", x["len"]).otherwise(0)


def mate_right_clip() -> Column:
    x = F.try_element_at(mate_ops(), F.lit(-1))
    return F.when((x["op"] == "S") & (F.size(mate_ops()) > 1), x["len"]).otherwise(0)


def can_align_to(target: Column, max_is: Column | int) -> Column:
    """Whether the read could lie at target, given where its mate is: within max_is on the side that the mate faces."""
    ahead = F.when(flag(MATE_REVERSE), mate_end() - target).otherwise(target - F.col("mpos"))
    return ~is_mate_unmapped() & ahead.between(0, max_is)


def perfectly_aligned() -> Column:
    return ~is_unmapped() & F.forall("cigar", lambda x: x["op"].isin("M", "=")) & (F.col("nm") == 0)


def poly_g_clip(least: int = 20, share: float = 0.8) -> Column:
    """A clip of at least so many bases at the sequencing 3' end that is mostly G (C where the read is reversed)."""
    n = F.when(flag(REVERSE), left_clip()).otherwise(right_clip())
    tail = F.when(flag(REVERSE), F.substr(F.col("seq"), F.lit(1), n)).otherwise(F.substr(F.col("seq"), F.length("seq") - n + 1, n))
    base = F.when(flag(REVERSE), "C").otherwise("G")
    return (n >= least) & (F.length(tail) - F.length(F.replace(tail, base, F.lit(""))) >= share * n)


def routes(min_mapq: int, min_clip: int, min_diff: int, min_size: int, min_is: int, max_is: int) -> Column:
    """The categories of a read: each of the chains gives one at most, and a read can be in several.

    stable_fwd or stable_rev for discordant reads with a stable end; long, else outward, else same_strand for pairs on one
    contig; sr for clipped reads, else hsr for hidden splits.
    """
    stable = F.when(discordant() & stable_end(min_mapq), F.when(flag(REVERSE), "stable_rev").otherwise("stable_fwd"))
    kind = pair_kind(min_is, max_is)
    pair = F.when(kind == "long", "long").when(kind == "outward", "outward").when(same_contig() & same_strand(), "same_strand")
    split = F.when((left_clip() >= min_clip) | (right_clip() >= min_clip), "sr").when(hidden_split(min_diff, min_size, min_mapq), "hsr")
    return F.array_compact(F.array(stable, pair, split))


def multi_route(*chains: list[tuple[Column, str]]) -> Column:
    """Array of labels: from each chain the label of its first condition that holds."""
    picked = []
    for chain in chains:
        c = F.lit(None).cast("string")
        for condition, label in reversed(chain):
            c = F.when(condition, label).otherwise(c)
        picked.append(c)
    return F.array_compact(F.array(*picked))


def is_pass(filters: str = "filters") -> Column:
    return F.col(filters).isNull() | (F.size(filters) == 0) | (F.get(filters, F.lit(0)) == "PASS")


def alt_alleles(gt: str = "gt") -> Column:
    return F.size(F.filter(gt, lambda x: x > 0))


def missing_alleles(gt: str = "gt") -> Column:
    return F.when(F.size(gt) < 2, 0).otherwise(F.size(F.filter(gt, lambda x: x.isNull())))


def supported_type(svtype: str = "svtype") -> Column:
    return F.col(svtype).isin("DEL", "INS", "DUP", "INV")


def incomplete_insertion(ins_seq: str = "ins_seq") -> Column:
    return F.col(ins_seq).contains("-")


def size() -> Column:
    """Length of a variant: the span for deletions, duplications and inversions, the inserted bases else."""
    span = F.col("end") - F.col("start")
    return F.when(F.col("svtype") == "INS", F.length("ins_seq")).when(F.col("svtype") == "DEL", F.greatest(span, F.length(F.coalesce("ins_seq", F.lit(""))))).otherwise(span)


def svlen() -> Column:
    """Inserted minus removed bases; the added span for duplications, 0 for inversions, null while an insertion is incomplete."""
    ins, span = F.length(F.coalesce("ins_seq", F.lit(""))), F.col("end") - F.col("start")
    known = F.when(F.col("svtype").isin("DEL", "INS"), ins - span).when(F.col("svtype") == "DUP", span + ins).when(F.col("svtype") == "INV", F.lit(0))
    return F.when(F.coalesce(incomplete_insertion(), F.lit(False)), F.lit(None)).otherwise(known).cast("long")


def is_small(limit: int = 50) -> Column:
    return (F.col("svtype") != "BND") & ~F.coalesce(incomplete_insertion(), F.lit(False)) & (size() < limit)


def homopolymer(seq: Column | str) -> Column:
    return F.col(seq).rlike(r"^(.)\1*$") if isinstance(seq, str) else seq.rlike(r"^(.)\1*$")


def quality_gate(training: bool = False, least: float = 0.05) -> Column:
    return F.lit(True) if training else F.col("epr") >= least


def appended_filters(*rules: tuple[Column, str]) -> Column:
    """The filters column with the names of the conditions that hold, each once."""
    more = F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))
    return F.array_union(F.coalesce("filters", F.array().cast("array<string>")), more)


def inversion_call(ratio: Column) -> Column:
    """Genotype by the share of positive evidence: from 0.75 homozygous, to 0.25 reference, else heterozygous."""
    gt = F.when(ratio >= 0.75, F.array(F.lit(1), F.lit(1))).when(ratio <= 0.25, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    return F.when(ratio.isNotNull(), gt)


def record_identity() -> Column:
    """A key under which two records are the same: alleles if they are literal, else end, type and inserted sequence."""
    literal = ~F.col("alt").startswith("<")
    return F.when(literal, F.concat_ws(":", "chr", "start", F.upper("ref"), F.upper("alt"))).otherwise(F.concat_ws(":", "chr", "start", "end", "svtype", F.coalesce("ins_seq", F.lit(""))))


def unique_key() -> Column:
    return F.concat_ws(":", "chr", "start", "end", "svtype", F.coalesce("ins_seq", F.lit("")))


def model_name(max_is: int, read_len: int) -> Column:
    """The model that scores a record; ids that end in _DUP are insertions tried as duplications."""
    t, n = F.col("svtype"), F.abs(svlen())
    exl = F.when(F.col("xal").isNull(), "_NOEXL").otherwise("")
    large = F.when(n >= max_is, "_LARGE").otherwise("")
    twin = F.col("id").endswith("_DUP")
    dup = F.when(F.col("end") - F.col("start") > read_len - 30, F.concat(F.lit("_LARGE"), exl)).otherwise("")
    return F.when(F.col("is_hp"), "HP").when(twin, F.concat(F.lit("INS_TO_DUP"), dup)).when(t == "DEL", F.concat(F.lit("DEL"), large, exl)).when(t == "DUP", F.concat(F.lit("DUP"), dup)).when(t == "INS", "INS")


def lone_deletion_candidate(read_len: int, high_mapq: int = 20) -> Column:
    """A split-read consensus that may be tried as a deletion by itself."""
    bounded = (F.col("other_lo") > F.lit(-(2**31))) & (F.col("other_hi") < 2**31 - 1)
    return ~F.col("is_hsr") & (F.col("max_mapq") >= high_mapq) & bounded & (F.col("clip_len") >= F.ceil(F.lit(read_len) / 3)) & ~F.col("seq").rlike("[^ACGT]")


SOURCES = ("2SR", "2HSR", "HSR-SR", "1SR_LC", "1SR_RC", "1HSR_LC", "1HSR_RC", "REFERENCE_GUIDED_ASSEMBLY", "DE_NOVO_ASSEMBLY", "DP", "READ")


def source_priority(source: str = "source") -> Column:
    """0 for the most trusted source of SOURCES; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col(source))
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(SOURCES)).otherwise(at - 1).cast("int")
