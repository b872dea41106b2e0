"""Packing token sequences by the sum-of-squares rule.

Documents come one at a time. Full windows are cut off a long one; what remains goes into the open window whose fill level
makes the sum over all levels of (number of windows at that level) squared smallest; the counts are an array by level, so
a placement is one vector expression. Each task packs its own documents. When a task ends, its open windows are merged by
cutting: the emptiest are poured into the gaps of the fullest, and the last one is split at powers of two, the lengths
that need no padding. Placing goes on however many windows are open: a task holds at most the ids of its own input, two
bytes each where the tokenizer's ids fit, so its memory is bounded by the size of a split (128 MB of Parquet by default).
``most_open`` can be set to merge open windows earlier; by default it isn't.

Defined cases: a null text counts as empty and yields the end token alone; a very long text fills windows of its own and
only its end is placed; repeated rows are packed each, a null doc_id like any other; other columns are not read; an empty
table gives no sequence. A sequence id is the task's number in the high bits and a running number in the low 40.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, tidy

END = 2
WINDOW = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Stands between words that are encoded together: a control character, one token; words that hold it are encoded alone.
BETWEEN = "\x01"
TOGETHER = 256
#: Marks of words that have come, a power of two.
MARKS = 1 << 22
#: So many texts are split at a time, and sent to a Python worker at a time: Spark holds a batch that it sends twice while it
#: grows, and a worker holds two.
TEXTS = 512


class WordCache:
    """Token ids of texts, from remembered ids of their words. Beyond ``limit`` words the later half is forgotten.

    The tokenizer drops white space and takes A-Z as a-z, so a text's ids are those of its words in turn. A word is remembered
    when it comes in a second part of the texts: most words of a large input come once, and would fill the memory for nothing.
    Marks tell which words have come; a mark that two words share makes one of them remembered at once, and no id depends on it.
    """

    def __init__(self, tokenizer_file: str, end: int = END, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        # Words come with A-Z as a-z and without white space, so there is nothing to normalise in plain ones. One tokenizer does
        # both kinds in turn: a second one would hold the vocabulary again.
        self.normal, self.plain = self.tokenizer.normalizer, normalizers.Sequence([])
        self.end, self.limit = end, limit
        self.between = np.array(self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids, np.uint32)
        self.number: dict[bytes, int] = {b"": 0}  # what leading and trailing white space leaves has no id
        # The words of number come first in the arrays, then those of the part at hand, which the next part overwrites.
        self.flat, self.first, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0
        self.marks = np.zeros(MARKS, bool)

    def _forget(self) -> None:
        """Keep the half that was learned first: common words come early."""
        kept = self.limit // 2
        self.number = {w: k for w, k in self.number.items() if k < kept}
        self.used = int(self.first[kept])
        self.marks[:] = False

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words, one after the other, and how many each has."""
        if len(words) > 1 and not any(BETWEEN in w for w in words):
            ids = np.array(self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            k = len(self.between)
            hit = np.ones(max(0, len(ids) - k + 1), bool)
            for j, x in enumerate(self.between):
                hit &= ids[j : j + len(hit)] == x
            at = np.flatnonzero(hit)
            if len(at) == len(words) - 1:
                gone = (at[:, None] + np.arange(k)).ravel()
                n = np.diff(np.concatenate(([-k], at, [len(ids)]))) - k
                return np.delete(ids, gone), n
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def learn(self, new: list[bytes], number: dict[bytes, int], known: int, used: int) -> tuple[int, int]:
        """Put new words behind the first known ones and their used ids, number them, and tell how many there are then of both."""
        for normalizer, words in ((self.plain, [w for w in new if w.isascii()]), (self.normal, [w for w in new if not w.isascii()])):
            if not words:
                continue
            self.tokenizer.normalizer = normalizer
            try:
                for k in range(0, len(words), TOGETHER):
                    part = words[k : k + TOGETHER]
                    ids, n = self._encoded([w.decode("utf-8", "replace") for w in part])
                    self.flat, self.first = _room(self.flat, used + len(ids)), _room(self.first, known + len(part))
                    self.flat[used : used + len(ids)] = ids
                    self.first[known : known + len(part)] = used + np.cumsum(n) - n
                    number.update(zip(part, range(known, known + len(part))))
                    known, used = known + len(part), used + len(ids)
            finally:
                self.tokenizer.normalizer = self.normal
        return known, used

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, int, int]:
        """The number of each word, and how many words and ids are in the arrays until the next call."""
        k = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(k < 0)
        known, used = len(self.number), self.used
        if len(new):
            missing = [words[i] for i in new.tolist()]
            different = list(dict.fromkeys(missing))
            at = np.fromiter(map(hash, different), np.int64, len(different)) & (MARKS - 1)
            came = self.marks[at]
            self.marks[at] = True
            known, self.used = self.learn([w for w, c in zip(different, came.tolist()) if c], self.number, known, used)
            passing: dict[bytes, int] = {}
            known, used = self.learn([w for w, c in zip(different, came.tolist()) if not c], passing, known, self.used)
            k[new] = [passing[w] if w in passing else self.number[w] for w in missing]
        return k, known, used

    def ids(self, text: str | None) -> np.ndarray:
        """The text's token ids and the end token, unsigned 32-bit."""
        return next(self.all_ids(pa.array([text], pa.string())))

    def all_ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """ids of each text. Arrow splits the texts and numbers their different words, so each is looked up once."""
        if len(self.number) > self.limit:
            self._forget()
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        ends_of = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        coded = lists.flatten().dictionary_encode()
        k, known, used = self.numbers(coded.dictionary.cast(pa.binary()).to_pylist())
        k = k[coded.indices.to_numpy()]
        # Words lie one after the other in flat, so they are a list array, and a text is what its words' numbers take.
        bounds = np.append(self.first[:known], used).astype(np.int32)
        taken = pa.ListArray.from_arrays(pa.array(bounds), pa.array(self.flat[:used])).take(pa.array(k))
        ids, at = taken.values.to_numpy(), taken.offsets.to_numpy()[ends_of].tolist()
        for a, b in zip(at[:-1], at[1:]):
            out = np.empty(b - a + 1, np.uint32)
            out[:-1], out[-1] = ids[a:b], self.end
            yield out


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


@lru_cache(maxsize=1)
def word_cache(tokenizer_file: str) -> WordCache:
    """A Python worker keeps its words from task to task."""
    return WordCache(tokenizer_file)


class Packer:
    """Open windows by fill level. A piece is (doc number, start in the document, ids)."""

    def __init__(self, window: int = WINDOW, most_open: int | None = None):
        self.window, self.most_open = window, most_open
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def choose(self, size: int) -> int:
        """The level to add to: 0 opens a window. Ties go to the fullest."""
        n, b = self.level, self.window
        after = n[size : b + 1].copy()
        after[-1] = 0  # a window that becomes full leaves the array
        cost = 2 * (after - n[: b - size + 1]) + 2
        cost[-1] -= 1
        cost[0] = 2 * n[size] + 1 if size < b else 0
        usable = n[: b - size + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        return int(len(cost) - 1 - np.argmin(cost[::-1]))

    def add(self, piece: tuple) -> list[list[tuple]]:
        """Windows that this piece completes, each a list of pieces."""
        size = len(piece[2])
        at = self.choose(size)
        if at:
            held = self.open[at].pop()
            self.level[at] -= 1
            self.n_open -= 1
            held.append(piece)
        else:
            held = [piece]
        if at + size == self.window:
            return [held]
        self.open[at + size].append(held)
        self.level[at + size] += 1
        self.n_open += 1
        return self.merge(last=False) if self.most_open and self.n_open > self.most_open else []

    def merge(self, last: bool) -> list[list[tuple]]:
        """Full windows out of the open ones, by cutting the emptiest into the gaps of the fullest; last: the rest too."""
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open.clear()
        self.level[:] = 0
        self.n_open = 0
        out, rest = [], []
        sizes = [sum(len(p[2]) for p in w) for w in windows]
        lo, hi = 0, len(windows) - 1
        spill: list[tuple] = []
        while lo <= hi:
            gap, w = self.window - sizes[lo], windows[lo]
            while gap and (spill or hi > lo):
                if not spill:
                    spill = windows[hi]
                    hi -= 1
                doc, start, ids = spill.pop()
                if len(ids) > gap:
                    spill.append((doc, start + gap, ids[gap:]))
                    ids = ids[:gap]
                w.append((doc, start, ids))
                gap -= len(ids)
            (out if not gap else rest).append(w)
            lo += 1
        if spill:
            rest.append(spill)
        # At most the pieces of one window are left, perhaps in two lists.
        left = [p for w in rest for p in w]
        if last:
            n = sum(len(p[2]) for p in left)
            for bit in reversed(range(n.bit_length())):
                if n >> bit & 1:
                    out.append(self._take(left, 1 << bit))
        elif left:
            level = sum(len(p[2]) for p in left)
            if level >= self.window:
                out.append(self._take(left, self.window))
                level -= self.window
            if level:
                self.open[level].append(left)
                self.level[level] += 1
                self.n_open += 1
        return out

    @staticmethod
    def _take(pieces: list[tuple], size: int) -> list[tuple]:
        """Cut the first size ids off pieces, in place."""
        out = []
        while size:
            doc, start, ids = pieces.pop(0)
            if len(ids) > size:
                pieces.insert(0, (doc, start + size, ids[size:]))
                ids = ids[:size]
            out.append((doc, start, ids))
            size -= len(ids)
        return out


def pack_documents(docs: Iterator[tuple[int | None, np.ndarray]], window: int = WINDOW, most_open: int | None = None) -> Iterator[list[tuple]]:
    """Sequences, each a list of pieces (doc_id, start, ids, tokens of the document)."""
    packer = Packer(window, most_open)
    for doc_id, ids in docs:
        doc, full = (doc_id, len(ids)), len(ids) - len(ids) % window
        for k in range(0, full, window):
            yield [(doc, k, ids[k : k + window])]
        if full < len(ids):
            # A copy, so that an open window doesn't keep a long document's ids.
            rest = ids[full:]
            yield from packer.add((doc, full, rest.astype(np.uint16) if rest.max() < 1 << 16 else rest.copy()))
    yield from packer.merge(last=True)


def _pack(tokenizer_file: str, window: int, most_open: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer_file)
        parts = (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS))
        documents = (x for p in parts for x in zip(p.column("doc_id").to_pylist(), cache.all_ids(p.column("text"))))
        sequence, rows = TaskContext.get().partitionId() << 40, []
        for pieces in pack_documents(documents, window, most_open):
            offset = 0
            for (doc_id, n), start, ids in pieces:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset))
                offset += len(ids)
            sequence += 1
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, most_open: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row for each piece of a document (doc_id, text); no shuffle. The pieces are a table in the shared folder."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    pieces = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(_pack(tokenizer_file, window, most_open)), PIECES)
    return scratch.table(pieces, "pieces", batch=TEXTS)


def public_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
