"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule says why a text is rejected. On a sample every rule's time and the share it rejects are measured; rules then run
in the order of rejection per cost, and a text that one rule rejects is not shown to the next (a CASE expression). The
order changes the work, never the verdict: a text is kept if and only if no rule rejects it. So rules may be dear.

Defined cases: a null text counts as empty, without words; empty texts fail the base rule of 50 words; repeated rows are
judged each; a very long text is judged whole, in one row; columns named like the measures (_sl_*) are replaced by them, all
others stay; an empty table gives an empty result, in the order in which the rules are written.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, Scratch, words


@dataclass(frozen=True)
class Rule:
    """rejects: a condition on the columns of measured()."""

    name: str
    rejects: Callable[[], Column]


def _share(part: Column, whole: str, least: float) -> Column:
    return part > least * F.col(whole)


def _surely(part: str, whole: str, least: float, z: float = 1.96) -> Column:
    """Whether the share of part in whole is over least even at the lower end of its 95 % interval (Wilson's)."""
    n, p = F.col(whole).cast("double"), F.col(part) / F.greatest(F.col(whole), F.lit(1))
    low = p + F.lit(z * z / 2) / n - F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z / 4) / (n * n))
    return (n > 0) & (low > F.lit(least) * (1 + F.lit(z * z) / n))


#: More symbols than a tenth of the words, surely more than three in ten lines repeated, odd word lengths, few words with a letter,
#: mostly capital letters, most lines cut off, most lines bullets.
RULES = (
    Rule("symbols", lambda: _share(F.col("_sl_symbols"), "_sl_words", 0.1)),
    Rule("repeated_lines", lambda: _surely("_sl_dup_lines", "_sl_lines", 0.3)),
    Rule("word_length", lambda: ~F.col("_sl_word_chars").between(2.5 * F.col("_sl_words"), 12.0 * F.col("_sl_words"))),
    Rule("few_letters", lambda: F.size(F.filter("_sl_w", lambda x: x.rlike(r"\p{L}"))) < 0.7 * F.col("_sl_words")),
    Rule("capitals", lambda: F.length(F.regexp_replace("_sl_text", r"[^\p{Lu}]+", "")) > 0.5 * F.length(F.regexp_replace("_sl_text", r"[^\p{L}]+", ""))),
    Rule("cut_lines", lambda: F.size(F.filter("_sl_l", lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"))) > 0.5 * F.col("_sl_lines")),
    Rule("bullets", lambda: F.size(F.filter("_sl_l", lambda x: x.rlike(r"\A[\x20\x09-\x0D]*[-*•]"))) > 0.9 * F.col("_sl_lines")),
)


def measured(docs: DataFrame) -> DataFrame:
    """docs with words, lines and the counts of the base rules, all in columns _sl_*.

    A three-word window found twice marks its words: 64-bit hashes of windows are sorted with their places, equal neighbours
    are repeats, and the places they cover are summed in order, so a text costs its length times the logarithm of it.
    """
    n = F.col("_sl_words")
    window = lambda x, i: F.struct(F.xxhash64(x, F.get("_sl_w", i + 1), F.get("_sl_w", i + 2)).alias("s"), i.alias("i"))
    twice = lambda e, k: (F.get("_sl_win", k + 1)["s"] == e["s"]) | (F.get("_sl_win", k - 1)["s"] == e["s"])
    places = F.sort_array(F.transform(F.filter("_sl_win", lambda e, k: F.coalesce(twice(e, k), F.lit(False))), lambda e: e["i"]))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).alias("last"))
    cover = F.aggregate("_sl_places", start, lambda a, p: F.struct((a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"), p.alias("last")), lambda a: a["total"])
    return (
        docs.withColumn("_sl_text", F.coalesce("text", F.lit("")))
        .withColumns({"_sl_w": words(F.col("text")), "_sl_l": F.filter(F.split("_sl_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
        .withColumns({"_sl_words": F.size("_sl_w").cast("long"), "_sl_lines": F.size("_sl_l").cast("long")})
        .withColumns(
            {
                "_sl_word_chars": F.length(F.array_join("_sl_w", "")).cast("long"),
                "_sl_symbols": F.length(F.regexp_replace("_sl_text", r"[^#*$%&|<>]+", "")).cast("long"),
                "_sl_dup_lines": (F.col("_sl_lines") - F.size(F.array_distinct("_sl_l"))).cast("long"),
                "_sl_win": F.when(n >= 3, F.sort_array(F.transform(F.slice("_sl_w", F.lit(1), F.greatest(n - 2, F.lit(0)).cast("int")), window))).otherwise(F.array()),
            }
        )
        .withColumn("_sl_places", places)
        .withColumn("_sl_repeat_words", cover)
    )


def in_order(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> list[Rule]:
    """rules by rejection per second on about sample_rows rows of docs (text); rules that reject nothing come last.

    Every row is drawn with the same odds, which follow from the count, so what is drawn doesn't grow with the table.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    needed = ["_sl_text", "_sl_w", "_sl_l", "_sl_words", "_sl_lines", "_sl_word_chars", "_sl_symbols", "_sl_dup_lines"]
    drawn = docs.select("text").sample(min(1.0, sample_rows / max(1, docs.count())), seed=9)
    sample = scratch.table(measured(drawn).select(*needed).repartition(8), "sample")

    def timed(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        n = sample.agg(F.sum(F.when(condition, 1).otherwise(0))).first()[0] or 0
        return time.perf_counter() - began, n

    timed(F.lit(True))
    idle = timed(F.lit(True))[0]
    gain = {}
    for r in rules:
        seconds, rejected = timed(r.rejects())
        gain[r.name] = rejected / max(seconds - idle, 1e-3)
    scratch.close()
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows with _sl_rejected_by: the first of rules, in this order, that rejects; null where none does."""
    verdict = F.lit(None).cast("string")
    for r in reversed(rules):
        verdict = F.when(r.rejects(), r.name).otherwise(verdict)
    return rows.withColumn("_sl_rejected_by", verdict)


BASE = Rule("base", lambda: (F.col("_sl_words") < 50) | (100 * F.col("_sl_repeat_words") > 50 * F.col("_sl_words")))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """docs (text) with the measures and _sl_rejected_by; the base rule stands first."""
    return cascade(measured(docs), [BASE, *in_order(docs, rules, sample_rows)])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for all documents."""
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = {"n_words": "_sl_words", "word_chars": "_sl_word_chars", "n_symbols": "_sl_symbols", "n_dup_lines": "_sl_dup_lines", "n_repeat_words": "_sl_repeat_words"}
    return found.select("doc_id", *[F.col(c).alias(k) for k, c in names.items()], BASE.rejects().alias("base_failed"), F.col("_sl_rejected_by").isNull().alias("kept"))
