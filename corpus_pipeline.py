"""A corpus pipeline of five stages: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet and reads again as the next
one's docs. All but the last return the columns of documents.

* language: documents whose language the compression classifier rejects go (no letter, or a margin too narrow).
* near_duplicates: of every SimHash component one document stays, that of the smallest doc_id; then of every cluster of
  texts whose five-word shingles are 0.8 alike (Jaccard).
* secrets: found secrets are replaced by a mark; every document stays, its n_chars follows.
* mixture: rows are repeated or left out so that sources come near their target weights.
* packing: the pieces of token sequences.

Null texts have no letter and go in the first stage; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import langid, mixing, packing, repeats, secrets, simhash
from spanloom.llm.common import Scratch, remainder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    train = F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(True))
    dictionaries = langid.fit(docs, train)
    return langid.identify(docs, dictionaries).where("not _sl_reject").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = Scratch(spark, "simhash")
    out = repeats.keep_first(simhash.keep_first(docs, scratch=first))
    first.close()  # what SimHash kept is written by now, in the table that out reads
    return out


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = Scratch(spark, "secrets").root + "/ledger"
    secrets.update_ledger(docs, ledger)
    return secrets.redact(docs, ledger)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.public_tokenizer())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixture", mixture), ("packing", packed)]
#: The language classifier, SimHash's components, the rounding draws and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each but the last is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
