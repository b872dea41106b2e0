"""Secret scans over an incremental ledger of content-addressed blobs, with DataFrame functions only.

Every text is a version of some path and is addressed by its SHA-256. The ledger holds one row for each blob and rule
version that was ever scanned, with its findings, so a run scans only the pairs it lacks and joins all findings back to
every path that holds the blob. A rule is changed by raising its version: only that rule is then run again.

Defined cases: a null text counts as empty; an empty text has no finding; repeated rows and equal texts are scanned once
and each row gets the findings; offsets count code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch


@dataclass(frozen=True)
class Rule:
    """pattern: a Java pattern without capturing groups but for ``value``, the group whose length is bounded.

    Matches are taken leftmost first and without overlap; those whose value is shorter than ``least`` are then dropped.
    ``hint``: a cheaper pattern that every kept match contains a match of.
    """

    kind: str
    version: int
    pattern: str
    least: int = 1
    value: int = 0
    hint: str = ""


#: The three base rules, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", 1, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1, r"(?i)(?:passw|secret|token|api_?key)"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, 0, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: Further public token formats.
MORE = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?", hint="PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh[pousr]_"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox[abprs]-"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hint=r"eyJ"),
)
LEDGER = "blob binary, kind string, version int, spans array<struct<start:long,end:long>>"


def _found(text: Column, rule: Rule) -> Column:
    """Array of (gap before the match, its length, the value's length), lengths in code points; empty where none is."""
    # Each match begins where the last one ended, so a text is read once however few matches it has.
    whole = rf"\G(?s)(.*?)({rule.pattern})"
    group = lambda k: F.regexp_extract_all(text, F.lit(whole), F.lit(k))
    value = group(2 + rule.value)
    got = F.zip_with(F.arrays_zip(group(1).alias("g"), group(2).alias("m")), value, lambda a, v: F.struct(F.length(a["g"]).alias("gap"), F.length(a["m"]).alias("len"), F.length(v).alias("value")))
    return F.when(text.rlike(rule.hint or rule.pattern), got)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for blobs (blob, text, todo): every kind in todo, with its spans in order."""
    each = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(F.array_contains("todo", r.kind), _found(F.col("text"), r)).alias("found")) for r in rules]))
    rows = blobs.select("blob", "todo", each.alias("x")).where(F.array_contains("todo", F.col("x.kind"))).select("blob", "x.*")
    one = rows.select("blob", "kind", "version", "least", F.posexplode_outer("found").alias("i", "m"))
    upto = Window.partitionBy("blob", "kind").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(upto)
    spans = one.select("blob", "kind", "version", F.when(F.col("m.value") >= F.col("least"), F.struct((end - F.col("m.len")).alias("start"), end.alias("end"))).alias("span"))
    return spans.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE + MORE) -> None:
    """Scan what the ledger (a Parquet folder) lacks of docs' blobs and rules, and append it there."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    blobs = docs.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    if _exists(spark, ledger):
        now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
        blobs = blobs.join(seen, "blob", "left").select("blob", "text", F.when(F.col("done").isNull(), now).otherwise(F.array_except(now, "done"))["kind"].alias("todo")).where(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    scan(blobs.dropDuplicates(["blob"]), rules).write.mode("append").parquet(ledger)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """All columns of docs and _sl_spans, its spans (start, rank of the kind, kind, end) in order; empty where none is."""
    spark = docs.sparkSession
    order = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    held = spark.read.schema(LEDGER).parquet(ledger).where((F.size("spans") > 0) & F.array_contains(current, F.struct("kind", "version")))
    flat = held.select("blob", F.explode(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order.alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end")))).alias("s"))
    by_blob = flat.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("_sl_spans")).withColumnRenamed("blob", "_sl_blob")
    keyed = docs.withColumn("_sl_blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    none = F.array().cast(by_blob.schema["_sl_spans"].dataType)
    return keyed.join(by_blob, "_sl_blob", "left").withColumn("_sl_spans", F.coalesce("_sl_spans", none)).drop("_sl_blob")


def redact(docs: DataFrame, ledger: str, mark: str = "[secret]", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with every found span replaced by mark; spans that overlap or touch are replaced by one mark.

    n_chars, where docs has it, follows the new text. Texts without a finding stay as they are, nulls included.
    """
    spans = F.aggregate(
        "_sl_spans",
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(
            F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        ),
    )
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.col("_sl_cuts"), lambda s: s["end"]))
    starts = F.concat(F.transform(F.col("_sl_cuts"), lambda s: s["start"]), F.array(F.length("text").cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substr(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    found = findings(docs, ledger, rules).withColumn("_sl_cuts", spans)
    out = found.withColumn("text", F.when(F.size("_sl_cuts") > 0, F.array_join(kept, mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_sl_cuts") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents over a ledger that begins empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = Scratch(spark, "secrets").root + "/ledger"
    update_ledger(docs, ledger)
    found = findings(docs, ledger)
    n = lambda kind: F.size(F.filter("_sl_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("_sl_spans", lambda s: s["rank"] <= len(BASE))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_sl_spans")).alias("spans"))
