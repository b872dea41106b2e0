"""Readers. Coordinates become 0-based; what a format calls missing becomes null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import overlap_semi

READS = "qname string, flag int, contig string, pos long, mapq int, cigar array<struct<op:string,len:int>>, mate_contig string, mpos long, isize long, seq string, qual array<short>, nm int, mq int, mc string, md string"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def _fields(spark: SparkSession, path: str | list[str], sep: str = r"\s+") -> DataFrame:
    return _lines(spark, path).select(F.split(F.trim("value"), sep).alias("f"))


def _at(k: int) -> Column:
    return F.get("f", F.lit(k))


def _checked(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """df; rows that are bad end the job with an error that shows one."""
    shown = F.concat(F.lit(what + ": "), F.to_json(F.struct(*df.columns)))
    return df.where(F.when(bad, F.raise_error(shown).isNull()).otherwise(True))


def reads(spark: SparkSession, path: str, contig: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Alignments from Parquet that is partitioned by contig; a contig prunes folders, a region filters by overlap.

    Binary alignment files have to be turned into this table beforehand; their codec is not part of this package.
    """
    df = spark.read.parquet(path)
    if contig is not None:
        df = df.where(F.col("contig") == contig)
    if start is not None:
        # Alignments are not longer than what their columns say: pos prunes row groups, the end decides.
        from ..functions.predicates import end as aligned_end

        df = df.where((F.col("pos") < end) & (aligned_end() > start))
    return df


def reads_in_regions(df: DataFrame, regions: DataFrame, width: int = 1000) -> DataFrame:
    """Reads that overlap any of the regions (contig, start, end, half-open), each once."""
    from ..functions.predicates import end as aligned_end

    keyed = df.withColumns({"_end": aligned_end() - 1, "_row": F.monotonically_increasing_id()})
    r = regions.select("contig", F.col("start").alias("_rs"), (F.col("end") - 1).alias("_re"))
    return overlap_semi(keyed, r, ["contig"], ("pos", "_end"), ("_rs", "_re"), width, ["_row"]).drop("_end", "_row")


def sampled_positions(df: DataFrame, positions: DataFrame, keep: Column, per: int = 101, total: int = 100_000, order: Sequence[str] = ("pos", "qname")) -> DataFrame:
    """At most per rows over each position (contig, at), and about total in all, in the order of positions."""
    from ..functions.predicates import end as aligned_end
    from ..operators.ranges import point_join
    from pyspark.sql.window import Window

    met = point_join(positions, df.where(keep).withColumn("_end", aligned_end() - 1), ["contig"], "at", ("pos", "_end"), 1000).drop("_end")
    ranked = met.withColumn("_r", F.row_number().over(Window.partitionBy("contig", "at").orderBy(*order))).where(F.col("_r") <= per)
    counts = ranked.groupBy("contig", "at").agg(F.count(F.lit(1)).alias("_n"))
    # A position has a row at least, so the first ``total`` positions are enough, and the running sum reads no more.
    first = counts.orderBy("contig", "at").limit(total)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("contig", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("_b", before).where(F.col("_b") < total).select("contig", "at")
    return ranked.join(kept, ["contig", "at"], "left_semi").drop("_r")


def random_positions(regions: DataFrame, n: int, seed: int, padding: int = 1000) -> DataFrame:
    """n places drawn evenly over regions (contig, start, end) without padding at their ends; repeatable by seed."""
    from pyspark.sql.window import Window

    from ..operators.ranges import point_join

    r = regions.select("contig", (F.col("start") + padding).alias("s"), (F.col("end") - padding).alias("e")).where("e > s")
    # Where a contig's regions begin in one long line of all: contigs are few, and a contig's regions are summed apart.
    sizes = r.groupBy("contig").agg(F.sum(F.col("e") - F.col("s")).alias("size"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(F.col("e") - F.col("s")).over(Window.partitionBy("contig").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))
    placed = r.withColumn("_o", own).join(sizes.withColumn("_b", before), "contig").withColumn("hi", F.col("_b") + F.col("_o") - 1)
    cum = placed.select("contig", "s", (F.col("hi") - (F.col("e") - F.col("s")) + 1).alias("lo"), "hi", F.lit(0).alias("line"))
    size, count = sizes.agg(F.sum("size"), F.sum("n")).first()
    spark = regions.sparkSession
    if not size:
        return spark.createDataFrame([], "contig string, at long")
    draws = spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size)).alias("x"), F.lit(0).alias("line"))
    hit = point_join(draws, cum, ["line"], "x", ("lo", "hi"), max(1, size // count))
    return hit.select("contig", (F.col("s") + F.col("x") - F.col("lo")).alias("at"))


def bed(spark: SparkSession, path: str | list[str], validate: bool = True) -> DataFrame:
    """contig, start, end (half-open) from three or more fields; comments and headings are passed over."""
    f = _fields(spark, path, r"\t|\s+").where(~_at(0).rlike(r"^(#|track$|browser$)"))
    out = f.select(_at(0).alias("contig"), _at(1).try_cast("long").alias("start"), _at(2).try_cast("long").alias("end"))
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("start") >= F.col("end"))
    return _checked(out, bad, "bad interval") if validate else out.where(~bad)


def inclusive_bed(spark: SparkSession, path: str) -> DataFrame:
    """bed with the last base as end."""
    return bed(spark, path).withColumn("end", F.col("end") - 1)


def sampling_regions(spark: SparkSession, path: str) -> DataFrame:
    """Exactly three fields a line."""
    return bed_of(_checked(_fields(spark, path), F.size("f") != 3, "three fields expected"))


def bed_of(f: DataFrame) -> DataFrame:
    return f.select(_at(0).alias("contig"), _at(1).cast("long").alias("start"), _at(2).cast("long").alias("end"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    """contig, length, in file order as index."""
    f = _fields(spark, path).withColumn("_i", F.monotonically_increasing_id())
    return f.select(_at(0).alias("contig"), _at(1).cast("long").alias("length"), F.col("_i").alias("index"))


def fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """contig, seq: one row a record. Records are rows of the scan, so a file is read by many tasks and a row holds a contig."""
    record = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^[^\S\n]*(\S*)", 1)
    body = F.when(F.instr("value", "\n") > 0, F.substr(F.col("value"), F.instr("value", "\n") + 1)).otherwise("")
    seq = F.translate(body, " \t\r\n", "")
    return record.select(head.alias("contig"), (F.upper(seq) if upper else seq).alias("seq"))


def key_values(spark: SparkSession, path: str) -> dict[str, str]:
    """A settings file: the first field of a line is the key, the rest its value."""
    rows = _lines(spark, path).select(F.regexp_extract(F.trim("value"), r"^(\S+)\s*(.*)$", 1).alias("k"), F.regexp_extract(F.trim("value"), r"^(\S+)\s*(.*)$", 2).alias("v")).collect()
    return {r["k"]: r["v"] for r in rows}


def stats(spark: SparkSession, path: str) -> DataFrame:
    """stat, key, value; the key "." holds for all contigs."""
    return _fields(spark, path).select(_at(0).alias("stat"), _at(1).alias("key"), _at(2).cast("long").alias("value"))


def stat_value(df: DataFrame, name: str, contig: Column, table: DataFrame) -> DataFrame:
    """df with the named statistic of a contig, or the one for all where it has none."""
    own = table.where(F.col("stat") == name)
    picked = own.where("key <> '.'").select(F.col("key").alias("_c"), F.col("value").alias("_own"))
    all_of = own.where("key = '.'").agg(F.max("value").alias("_all"))
    return df.withColumn("_c", contig).join(picked, "_c", "left").join(all_of, how="left").withColumn(name, F.coalesce("_own", "_all")).drop("_c", "_own", "_all")


def mate_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """qname, seq, qual, mapq; lines with fewer than four fields have no quality and mapq."""
    return _fields(spark, path).select(_at(0).alias("qname"), _at(1).alias("seq"), F.when(F.size("f") >= 4, _at(2)).alias("qual"), F.when(F.size("f") >= 4, _at(3).try_cast("int")).alias("mapq"))


#: Fixed order of the fields of a consensus line.
CONSENSUS = ("start long", "end long", "breakpoint long", "direction string", "seq string", "qual string", "fwd int", "rev int", "max_mapq int", "other_lo long", "other_hi long", "lowq_prefix int", "lowq_suffix int", "is_hsr boolean", "seq_bp_idx int")


def consensuses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One clip consensus a line; further fields are indel lengths."""
    names = [c.split() for c in CONSENSUS]
    typed = [(_at(k) == "1" if t == "boolean" else _at(k).try_cast(t)).alias(n) for k, (n, t) in enumerate(names)]
    n = len(names)
    more = F.transform(F.slice("f", n + 1, F.greatest(F.size("f") - n, F.lit(0))), lambda x: x.cast("int")).alias("indel_lengths")
    return _fields(spark, path).select(*typed, more)


def evidence(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """Evidence of one kind: alt (sv_id, bp, read, score, pos, alt_idx), ref (read, sv_id, bp), er (read, sv_id), td (sv_id)."""
    fields = {"alt": "sv_id string, bp int, read string, score int, pos long, alt_idx int", "ref": "read string, sv_id string, bp int", "er": "read string, sv_id string", "td": "sv_id string"}[kind]
    return _fields(spark, path).select(*[_at(k).cast(t).alias(n) for k, (n, t) in enumerate(x.split() for x in fields.split(", "))])


def genotype_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, gt, exact, cnu, one row an id: the genotype with more alternative alleles, the larger exact; cnu -1 on conflict."""
    f = _fields(spark, path)
    rows = f.select(_at(0).alias("id"), F.replace(_at(1), F.lit("|"), F.lit("/")).alias("gt"), _at(2).try_cast("int").alias("exact"), _at(3).try_cast("int").alias("cnu"))
    alts = F.size(F.filter(F.split("gt", "/"), lambda x: (x != "0") & (x != ".")))
    best = F.max_by("gt", F.struct(alts, "gt"))
    return rows.groupBy("id").agg(best.alias("gt"), F.max("exact").alias("exact"), F.when(F.min("cnu") != F.max("cnu"), -1).otherwise(F.max("cnu")).alias("cnu"))


def file_list(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    return [(r["f"][0], r["f"][1]) for r in _fields(spark, path).collect()]


def variants_of_files(spark: SparkSession, listing: str) -> DataFrame:
    """The variants of all files of a listing, with their sample: one scan, samples joined by file name."""
    from .vcf import read_vcf

    files = file_list(spark, listing)
    names = spark.createDataFrame([(p.rsplit("/", 1)[-1], s) for s, p in files], "_file string, sample string")
    df = read_vcf(spark, [p for _, p in files], with_file=True)
    return df.withColumn("_file", F.element_at(F.split("_file", "/"), -1)).join(F.broadcast(names), "_file").drop("_file")


def calibration(spark: SparkSession, path: str, columns: dict[str, str], contiguous: str | None = None, unit: Sequence[str] = (), unique: Sequence[str] = ()) -> DataFrame:
    """A calibration table: the exact header, typed values without trailing text, shares within 0 and 1, no key twice.

    contiguous names a column that must hold 0, 1, 2 ... without a gap.
    """
    head = spark.read.text(path).first()
    if head is None or head["value"].split("\t") != list(columns):
        raise ValueError(f"header expected: {' '.join(columns)}")
    raw = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{c} string" for c in columns))
    df = raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in columns.items()])
    bad = F.lit(False)
    for c, t in columns.items():
        bad = bad | F.col(c).isNull()
        if t in ("double", "float"):
            bad = bad | F.isnan(c)
    for c in unit:
        bad = bad | ~F.col(c).between(0, 1)
    df = _checked(df, bad, "bad calibration row")
    if contiguous:
        n = df.agg(F.count_distinct(contiguous), F.max(contiguous), F.min(contiguous)).first()
        if n[0] and (n[2] != 0 or n[1] != n[0] - 1):
            raise ValueError(f"{contiguous} must run from 0 without a gap")
    if unique and df.groupBy(*unique).count().where("count > 1").limit(1).collect():
        raise ValueError("a key occurs twice")
    return df


def check_reference(contigs: DataFrame, header: DataFrame) -> DataFrame:
    """Rows of header (contig, length, m5) that contigs (contig, seq) lack or contradict, with the reason."""
    known = contigs.select("contig", F.length("seq").cast("long").alias("_len"), F.md5(F.upper("seq")).alias("_md5"))
    why = F.when(F.col("_len").isNull(), "missing").when(F.col("_len") != F.col("length"), "length").when(F.col("m5").isNotNull() & (F.lower("m5") != F.col("_md5")), "checksum")
    return header.join(known, "contig", "left").withColumn("reason", why).where("reason is not null").select(*header.columns, "reason")
