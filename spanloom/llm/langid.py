"""Language identification by compression: the language whose dictionary makes the text smallest.

Each language gets one raw-content zstandard dictionary, made of labelled training texts. A text is cut into blocks
of ``block`` bytes, every block is compressed with every dictionary, and the language with the smallest sum wins. The
margin is the share of bytes that the winner saves against the runner-up; ``reject`` marks texts whose margin is narrow.

Training reads a bounded sample, as a parameter: of each language the ``per_language`` training rows with the smallest
hash in as many hash slots, and of each of these as many first bytes as make ``dictionary_bytes`` when all give alike.
Prediction reads every byte of every text.

Defined cases: null texts and texts without a letter get ``und`` with score 0 and are rejected; without any labelled
training row every text is ``und``; ties go to the language first by code point; a single learned language scores 1;
repeated rows are told each and alike; very long texts are read block by block, in memory that their length bounds; columns
named _sl_lang, _sl_score or _sl_reject are not to come with the input; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import remainder, tidy

UND = "und"
FAST, THOROUGH = 3, 12
#: Anything but letters becomes one space, so that numbers, marks and markup weigh nothing.
NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> bytes:
    return NOT_LETTERS.sub(" ", (text or "").lower()).strip().encode("utf-8", "ignore")


def fit(docs: DataFrame, train: Column, per_language: int = 96, dictionary_bytes: int = 96 << 10) -> dict[str, bytes]:
    """A dictionary for each language of docs (doc_id, text, lang) where train holds.

    Of a sampled text as much enters as makes the dictionary full when all give alike, a bound that is set by language: the
    smallest number of bytes of each text that together fill ``dictionary_bytes``. Texts are cut before they are sent.
    """
    slot = F.xxhash64(F.col("doc_id").cast("string"), F.lit(8))
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "doc_id", slot.alias("h"))
    picked = rows.groupBy("lang", F.pmod("h", F.lit(per_language)).alias("s")).agg(F.min("h").alias("h")).collect()
    chosen = docs.where(train & F.col("lang").isNotNull() & slot.isin([r["h"] for r in picked])) if picked else docs.limit(0)
    texts = defaultdict(set)
    for r in chosen.groupBy("lang", slot.alias("h")).agg(F.left(F.min("text"), F.lit(dictionary_bytes)).alias("text")).toLocalIterator():
        texts[r["lang"]].add((r["h"], r["text"] or ""))
    out = {}
    for lang, found in sorted(texts.items()):
        parts = [plain(t) for _, t in sorted(found)]
        room = dictionary_bytes - len(parts)
        # Short texts leave room that the longer ones share.
        share, left = max(1, room), room
        for k, n in enumerate(sorted(map(len, parts))):
            share = max(1, left // (len(parts) - k))
            if n > share:
                break
            left -= n
        out[lang] = b" ".join(p[:share] for p in parts)[:dictionary_bytes]
    return out


class Classifier:
    """Fast coders for every text, thorough ones for a second look where the fast ones leave a narrow margin."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = 1024, look_again: float = 0.05):
        self.langs, self.block, self.look_again = sorted(dictionaries), block, look_again
        self.fast, self.thorough = ([self._coder(dictionaries[x], level) for x in self.langs] for level in (FAST, THOROUGH))

    def _coder(self, dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(dictionary or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(level, source_size=self.block, dict_size=len(dictionary), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def _best(self, coders: list, blocks: list[bytes]) -> tuple[str, float]:
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
        first, second = np.argsort(sizes, kind="stable")[:2]
        return self.langs[first], float((sizes[second] - sizes[first]) / sizes[second])

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        raw = plain(text)
        if not raw or not self.langs:
            return UND, 0.0, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0
        blocks = [raw[k : k + self.block] for k in range(0, len(raw), self.block)]
        lang, margin = self._best(self.fast, blocks)
        if margin < self.look_again:
            lang, margin = self._best(self.thorough, blocks)
        return lang, min(1.0, 0.5 + margin), margin


def _predict(dictionaries: dict[str, bytes], min_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for b in batches:
            got = [classifier.predict(t.as_py()) for t in b.column("text")]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] < min_margin or g[0] == UND for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "_sl_lang", "_sl_score", "_sl_reject"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.01) -> DataFrame:
    """docs with _sl_lang, _sl_score (0 to 1) and _sl_reject."""
    more = [StructField("_sl_lang", StringType()), StructField("_sl_score", DoubleType()), StructField("_sl_reject", BooleanType())]
    return docs.mapInArrow(tidy(_predict(dictionaries, min_margin)), StructType([*docs.schema.fields, *more]))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), F.col("_sl_lang").alias("lang_pred"), F.col("_sl_score").alias("score"), F.col("_sl_reject").alias("rejected"))
