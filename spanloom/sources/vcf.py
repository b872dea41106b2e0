"""Variant call files as text: a parser and an encoder made of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import haplotype_id
from ..functions.predicates import unique_key

LITERAL = 100
HEADER = (
    "##fileformat=VCFv4.2",
    '##INFO=<ID=END,Number=1,Type=Integer,Description="Last base of the variant">',
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of the variant">',
    '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Inserted minus removed bases">',
    '##INFO=<ID=SVINSLEN,Number=1,Type=Integer,Description="Inserted bases">',
    '##INFO=<ID=SVINSSEQ,Number=1,Type=String,Description="Inserted sequence">',
    '##INFO=<ID=LEFT_SVINSSEQ,Number=1,Type=String,Description="Known front of the inserted sequence">',
    '##INFO=<ID=RIGHT_SVINSSEQ,Number=1,Type=String,Description="Known end of the inserted sequence">',
    '##INFO=<ID=SOURCE,Number=1,Type=String,Description="What found the variant">',
    '##INFO=<ID=HPID,Number=1,Type=Integer,Description="Haplotype">',
    '##INFO=<ID=IMPRECISE,Number=0,Type=Flag,Description="Places are not exact">',
    '##INFO=<ID=INCOMPLETE_ASSEMBLY,Number=0,Type=Flag,Description="The inserted sequence has an unknown middle">',
    '##INFO=<ID=AUX_SNPS,Number=.,Type=String,Description="Mismatches on the haplotype">',
    '##INFO=<ID=AUX_INDELS,Number=.,Type=String,Description="Indels on the haplotype">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=FT,Number=1,Type=String,Description="Filters">',
    '##FORMAT=<ID=EPR,Number=1,Type=Float,Description="Probability that the variant exists">',
)


#: Fixed names of the tag families: reads, pairs and stray pairs; {a} is the allele, {k} the breakpoint.
READ_TAGS = "{a}R{k} {a}R{k}C {a}R{k}CF {a}R{k}CR {a}R{k}CE {a}R{k}CEHQ {a}R{k}CEmQ {a}R{k}CEMQ {a}R{k}CEF {a}R{k}CER {a}R{k}E {a}R{k}EHQ {a}R{k}EmQ {a}R{k}EMQ {a}R{k}EF {a}R{k}ER {a}R{k}CAS {a}R{k}CSS {a}R{k}CHQ {a}R{k}CmQ {a}R{k}CMQ {a}R{k}CAQ {a}R{k}CSQ {a}R{k}CMSPAN {a}R{k}CMHQSPAN".split()
PAIR_TAGS = "{a}SP{k} {a}SP{k}HQ {a}SP{k}mQ {a}SP{k}MQ {a}SP{k}AQ {a}SP{k}SQ {a}SP{k}SPAN {a}SP{k}NMA {a}SP{k}NMS".split()
STRAY_TAGS = "SSP{k} SSP{k}HQ SSP{k}mQ SSP{k}MQ SSP{k}AQ SSP{k}SQ SSP{k}NMA SSP{k}NMS".split()
FILTERS = "REMAP_BOUNDARY_FILTER FAILED_TO_EXTEND ANOMALOUS_FLANKING_DEPTH ANOMALOUS_SC_NUMBER NOT_ENOUGH_DISC_PAIRS LOW_MAPQ_DISC_PAIRS WEAK_SUPPORT LOW_PTN_RATIO SHORT_ANCHOR LOW_ALT_CONSENSUS_SCORE".split()
ALTS = "DEL DUP INS INV BND RPL".split()


def support_tags() -> list[tuple[str, int, str]]:
    """Name, number and type of every support tag: averages and deviations are floats, spans and pair qualities have two values."""
    names = [t.format(a=a, k=k) for a in "AR" for k in "12" for t in READ_TAGS] + [t.format(a=a, k=k) for a in "ARN" for k in "12" for t in PAIR_TAGS] + [t.format(k=k) for k in "12" for t in STRAY_TAGS]
    real = ("AS", "SS", "AQ", "SQ", "NMA", "NMS")
    two = lambda n: n[1:3] == "SP" and n[-2:] in ("HQ", "mQ", "MQ", "AQ", "SQ", "AN") or n.endswith("SPAN")
    return [(n, 2 if two(n) else 1, "Float" if n.endswith(real) else "Integer") for n in names]


def support_header() -> list[str]:
    lines = [f'##FORMAT=<ID={n},Number={k},Type={t},Description="Support {n}">' for n, k, t in support_tags()]
    lines += [f'##FILTER=<ID={f},Description="{f.replace("_", " ").capitalize()}">' for f in FILTERS]
    return lines + [f'##ALT=<ID={a},Description="{a}">' for a in ALTS]


def header(contigs: list[tuple[str, int]], samples: list[str]) -> list[str]:
    names = [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    return [HEADER[0], *names, *HEADER[1:], *support_header(), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def _info(name: str) -> Column:
    return F.try_element_at("info", F.lit(name))


def svtype() -> Column:
    """SVTYPE, else the symbolic ALT, else by the lengths of REF and ALT."""
    n = F.length("alt") - F.length("ref")
    by_length = F.when(n < 0, "DEL").when(n > 0, "INS").when(F.length("ref") == 1, "SNP").otherwise("MNP")
    return F.coalesce(_info("SVTYPE"), F.when(F.col("alt").startswith("<"), F.regexp_extract("alt", r"^<([^>]*)>", 1)), F.when(F.col("alt").rlike(r"[\[\]]"), F.lit("BND")), by_length)


def end() -> Column:
    """0-based last base: END, else the literal REF, else the start of insertions, else start plus |SVLEN|."""
    return F.coalesce(
        _info("END").cast("long") - 1,
        F.when(~F.col("alt").startswith("<"), F.col("start") + F.length("ref") - 1),
        F.when(F.col("svtype") == "INS", F.col("start")),
        F.col("start") + F.abs(_info("SVLEN").cast("long")),
        F.when(F.col("svtype") == "BND", F.regexp_extract("alt", r":(\d+)", 1).cast("long") - 1),
    )


def inserted() -> Column:
    """Known front and end around '-', else a literal ALT without its first base, else SVINSSEQ, else empty."""
    left, right = F.coalesce(_info("LEFT_SVINSSEQ"), F.lit("")), F.coalesce(_info("RIGHT_SVINSSEQ"), F.lit(""))
    literal = F.upper("alt").rlike("^[ACGTN]+$") & (F.length("alt") > 1)
    return F.when((left != "") | (right != ""), F.concat(left, F.lit("-"), right)).when(literal, F.substr(F.col("alt"), F.lit(2))).otherwise(F.coalesce(_info("SVINSSEQ"), F.lit("")))


def parse(lines: DataFrame) -> DataFrame:
    """Variants from text rows (value); headings and records of unknown end are left out.

    Columns: chr, start, end (0-based), id, ref, alt, svtype, ins_seq, filters, info map, fmt map of the first sample, gt,
    epr, imprecise, source, hpid, aux_snps, aux_indels.
    """
    f = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", "\t"))
    at = lambda k: F.get("f", F.lit(k))
    pairs = F.transform(F.filter(F.split(at(7), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substr(x, F.length(F.substring_index(x, "=", 1)) + 2).alias("value")))
    info = F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda a, x: F.when(F.exists(a, lambda y: y["key"] == x["key"]), a).otherwise(F.concat(a, F.array(x)))))
    fmt = F.when(at(9).isNotNull(), F.map_from_arrays(F.split(at(8), ":"), F.slice(F.concat(F.split(at(9), ":"), F.array_repeat(F.lit("."), F.size(F.split(at(8), ":")))), F.lit(1), F.size(F.split(at(8), ":")))))
    keep = [c for c in lines.columns if c != "value"]
    rows = f.select(*keep, at(0).alias("chr"), (at(1).cast("long") - 1).alias("start"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(6).alias("filter"), info.alias("info"), fmt.alias("fmt"))
    rows = rows.withColumn("svtype", svtype()).withColumns({"end": end(), "ins_seq": inserted()})
    value = lambda k: F.when(F.try_element_at("fmt", F.lit(k)) != ".", F.try_element_at("fmt", F.lit(k)))
    filters = F.filter(F.split(F.coalesce(value("FT"), F.when(F.col("filter") != ".", F.col("filter")), F.lit("PASS")), "[;,]"), lambda x: x != "")
    gt = F.array_sort(F.transform(F.split(value("GT"), "[/|]"), lambda x: x.try_cast("int")))
    snps = F.transform(F.split(_info("AUX_SNPS"), ","), lambda x: F.struct((F.split(x, ":")[0].cast("long") - 1).alias("pos"), F.split(x, ":")[1].alias("alt")))
    indels = F.transform(F.split(_info("AUX_INDELS"), ","), lambda x: F.struct((F.split(x, ":")[0].cast("long") - 1).alias("start"), (F.split(x, ":")[1].cast("long") - 1).alias("end"), F.coalesce(F.get(F.split(x, ":"), F.lit(2)), F.lit("")).alias("ins_seq")))
    more = {"filters": filters, "gt": gt, "epr": value("EPR").cast("double"), "imprecise": F.map_contains_key("info", "IMPRECISE"), "source": _info("SOURCE"), "hpid": _info("HPID").cast("long"), "aux_snps": snps, "aux_indels": indels}
    return rows.withColumns(more).drop("filter").where(F.col("end").isNotNull())


def read_vcf(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    lines = spark.read.text(path)
    return parse(lines.withColumn("_file", F.input_file_name()) if with_file else lines)


def reference_bases(seq: Column) -> tuple[Column, Column]:
    """base and removed for encode, out of the whole sequence of a variant's contig."""
    return F.substr(seq, (F.col("start") + 1).cast("int"), F.lit(1)), F.substr(seq, (F.col("start") + 2).cast("int"), (F.col("end") - F.col("start")).cast("int"))


def encode(variants: DataFrame, base: Column, removed: Column, sample: bool = True) -> DataFrame:
    """Variants as text rows (value). base: the reference base at start; removed: those of start + 1 to end.

    Deletions and insertions of up to LITERAL removed bases are written out, others symbolically; END is left out where
    alleles are literal; a duplication has no SVLEN.
    """
    t, span = F.col("svtype"), F.col("end") - F.col("start")
    incomplete = F.col("ins_seq").contains("-")
    literal = t.isin("DEL", "INS") & (span <= LITERAL) & ~(incomplete & (t == "INS"))
    ref = F.when(literal, F.concat(base, F.substr(removed, F.lit(1), span.cast("int")))).otherwise(base)
    mate = F.concat(F.col("chr"), F.lit(":"), (F.col("end") + 1).cast("string"))
    left = F.coalesce(F.col("left_facing"), F.lit(False)) if "left_facing" in variants.columns else F.lit(False)
    bnd = F.when(left, F.concat(F.lit("["), mate, F.lit("["), base)).otherwise(F.concat(F.lit("]"), mate, F.lit("]"), base))
    alt = F.when(t == "BND", bnd).when(literal, F.concat(base, F.coalesce("ins_seq", F.lit("")))).otherwise(F.concat(F.lit("<"), t, F.lit(">")))
    symbolic = ~literal & (t != "BND")
    part = lambda k: F.split("ins_seq", "-")[k]
    pair = lambda k, v, when=None: F.when(v.isNotNull() & (v.cast("string") != "") & (when if when is not None else F.lit(True)), F.concat(F.lit(f"{k}="), v.cast("string")))
    size = F.length("ins_seq") - F.when(t.isin("DEL", "INS"), span).otherwise(0)
    items = [
        pair("END", F.col("end") + 1, ~literal),
        pair("SVTYPE", t),
        pair("SVLEN", size, t.isin("DEL", "INS") & ~incomplete),
        pair("SVINSLEN", F.length("ins_seq"), (F.length("ins_seq") > 0) & ~incomplete & (t != "DUP")),
        pair("SVINSSEQ", F.col("ins_seq"), symbolic & ~incomplete),
        pair("LEFT_SVINSSEQ", part(0), symbolic & incomplete),
        pair("RIGHT_SVINSSEQ", F.when(incomplete, part(1)), symbolic & incomplete),
        pair("SOURCE", F.col("source")),
        pair("HPID", F.col("hpid")),
        F.when(F.col("imprecise"), "IMPRECISE"),
        F.when(incomplete, "INCOMPLETE_ASSEMBLY"),
    ]
    if "aux_snps" in variants.columns:
        items.append(pair("AUX_SNPS", F.array_join(F.transform("aux_snps", lambda x: F.concat_ws(":", (x["pos"] + 1).cast("string"), x["alt"])), ",")))
        items.append(pair("AUX_INDELS", F.array_join(F.transform("aux_indels", lambda x: F.concat_ws(":", (x["start"] + 1).cast("string"), (x["end"] + 1).cast("string"), x["ins_seq"])), ",")))
    info = F.array_join(F.array_compact(F.array(*items)), ";")
    gt = F.array_join(F.transform("gt", lambda x: F.coalesce(x.cast("string"), F.lit("."))), "/")
    ft = F.when(F.size("filters") > 0, F.array_join("filters", ";")).otherwise("PASS")
    epr = F.coalesce(F.col("epr").cast("string"), F.lit("."))
    tail = [F.lit("GT:FT:EPR"), F.concat_ws(":", F.coalesce(gt, F.lit("./.")), F.coalesce(ft, F.lit("PASS")), epr)] if sample else []
    return variants.select(F.concat_ws("\t", "chr", (F.col("start") + 1).cast("string"), F.coalesce("id", F.lit(".")), ref, alt, F.lit("."), F.lit("."), info, *tail).alias("value"))


def with_haplotype_id(variants: DataFrame) -> DataFrame:
    """hpid from the variant's key and those of its further mismatches and indels, whatever their order."""
    snps = F.transform(F.coalesce("aux_snps", F.array().cast("array<struct<pos:long,alt:string>>")), lambda x: F.concat_ws(":", F.col("chr"), x["pos"].cast("string"), x["alt"]))
    indels = F.transform(F.coalesce("aux_indels", F.array().cast("array<struct<start:long,end:long,ins_seq:string>>")), lambda x: F.concat_ws(":", F.col("chr"), x["start"].cast("string"), x["end"].cast("string"), F.when(x["end"] > x["start"], "DEL").otherwise("INS"), x["ins_seq"]))
    return variants.withColumn("hpid", haplotype_id(F.concat(F.array(unique_key()), snps, indels)))
