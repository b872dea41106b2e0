"""Substring deduplication by paragraphs (MinHash banding, exact verification, removals by component) and by passages.

A paragraph is a line of at least ``min_words`` words. Shorter lines and copies inside longer lines or across line ends are
found as passages, exact copies of 50 words or more (``repeated_passages``). Equal paragraphs (A-Z as a-z, white
space aside) are one class. A class gets ``bands`` bands of ``rows`` minima over its five-word shingles: at similarity 0.8
twelve bands of four miss fewer than two pairs in a thousand. Classes that share a band are joined, every joined pair is
verified by the exact Jaccard similarity of its shingle sets, and verified pairs are clustered by components.

Within a band's bucket classes are ordered by their next band, so that those which share both stand together. Each is
paired with the ``near`` classes before it, so a bucket of up to near + 1 classes is compared in full, and in larger ones
also with the ``hubs`` most widely occurring. Components of these links settle most of a large bucket: pairs within one
component need no look. In a second pass every class outside its bucket's largest component is compared with the classes
of the bucket in other components that it can be alike to, so each pair that shares a band is verified, implied by a
component, or ruled out: shingles that no other class of such buckets has can't be shared, which bounds the sizes of the
sets that a class can be alike to. Classes are joined by these sizes, so copies with too many edits of their own meet none.
Of pairs that meet, in either pass, those are left out whose bit maps of shingles show that they share too few: each bit that
one map has alone is a shingle that the other lacks, so no pair that is alike is lost.
At worst, where classes share most shingles but no two are alike, the work is the square of a bucket.

A cluster is reported if it lies in two documents or more; its first paragraph by (doc_id, place) stays, all others can be
removed. Defined cases: null and empty texts have no paragraph; repeated rows are documents of their own; a null doc_id
comes last; an empty table gives an empty result. Class ids are 64-bit hashes of the paragraph's words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, connected_components, tidy

SHINGLE = 5
PLACES = "row long, doc_id long, paragraph int, start long, length long, n_words int, class long, bands array<long>"
#: A task remembers so many classes whose bands it has told.
REMEMBER = 1_000_000
GRAMS = "row long, doc_id long, gram long, at int, again boolean"
CONTEXTS = "gram long, row long, at int, f_row long, side int, before binary, after binary"
SPANS = "kind int, row long, doc_id long, a int, z int, run long, f_row long, f_doc long, f_a int"
SPAN_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
PASSAGES = "row long, doc_id long, paragraph int, start long, length long, n_words int, cluster_id long, n_places long, first_doc_id long, removed boolean"
#: Base of the polynomial over words; odd, so that it has an inverse.
BASE = 0x9E3779B97F4A7C15
ODD = np.random.default_rng(5).integers(1 << 62, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** 1 to n and their inverses, modulo 2^64; kept and made longer when asked for more."""
    global _POWERS
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16, 2 * len(_POWERS[0]))
        _POWERS = tuple(np.cumprod(np.full(n, x, np.uint64), dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
    return _POWERS


_POWERS: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text, and where its words start and end."""
    x = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(x) + 2, bool)
    inside[1:-1] = (x != 32) & ((x < 9) | (x > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return x, edge[::2], edge[1::2]


#: So many bytes are hashed at a time.
BLOCK = 1 << 20


def hashed_words(raw: bytes) -> np.ndarray:
    """A hash of each word: a polynomial over its bytes and its length, mixed."""
    out, at = [], 0
    while at < len(raw):
        cut = at + BLOCK
        while cut < len(raw) and raw[cut] not in b" \t\n\v\f\r":
            cut += 1
        x, starts, ends = word_places(raw[at:cut])
        power, inverse = powers(len(x) + 1)
        upto = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], out=upto[1:])
        out.append(mixed((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        at = cut
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint64), *out])


def word_hashes(text: str | None) -> tuple[bytes, np.ndarray]:
    """The text in UTF-8, A-Z as a-z, and the hashes of its words."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    return raw, hashed_words(raw)


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, by a polynomial modulo 2^64; h has n words at least."""
    power, inverse = powers(len(h))
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)))
    return mixed((upto[n:] - upto[:-n]) * inverse[: len(h) - n + 1])


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def paragraphs(text: str | None, min_words: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """Number, start and length in code points, and words of each line that is long enough."""
    at = 0
    for k, line in enumerate((text or "").split("\n")):
        if len(line) >= 2 * min_words - 1:
            w = line.encode("utf-8", "surrogatepass").lower().split()
            if len(w) >= min_words:
                yield k, at, len(line), w
        at += len(line) + 1


class Bands:
    def __init__(self, bands: int = 12, rows: int = 4, seed: int = 2):
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(seed)
        self.a = draw.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(1 << 63, size=bands * rows, dtype=np.uint64)
        self.fold = draw.integers(1 << 62, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, paragraphs: list[list[bytes]]) -> np.ndarray:
        """Band keys, signed 64-bit, one row for each paragraph of at least SHINGLE words."""
        n = np.array([len(p) for p in paragraphs])
        w = hashed_words(b"\n".join(map(b" ".join, paragraphs)))
        h = sum(w[j : len(w) - SHINGLE + 1 + j] * ODD[j] for j in range(SHINGLE))
        starts = np.cumsum(n) - n
        inside = np.ones(len(w), bool)
        for j in range(1, SHINGLE):
            inside[starts + n - j] = False
        h = mixed(h[inside[: len(h)]])
        count = n - SHINGLE + 1
        first = np.cumsum(count) - count
        low = np.empty((len(self.a), len(n)), np.uint64)
        for k, (a, b) in enumerate(zip(self.a, self.b)):
            low[k] = np.minimum.reduceat(h * a + b, first)
        keys = (low.reshape(self.bands, self.rows, -1) * self.fold[None, :, None]).sum(axis=1, dtype=np.uint64)
        return mixed(keys + np.arange(self.bands, dtype=np.uint64)[:, None]).view(np.int64).T


def _places(min_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, told = Bands(bands, rows), set()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out, new = [], {}
                for row, doc_id, t in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), part.column("text")):
                    for k, start, length, w in paragraphs(t.as_py(), min_words):
                        c = signed(xxhash.xxh3_64_intdigest(b" ".join(w)))
                        fresh = c not in told and c not in new
                        if fresh:
                            new[c] = w
                        out.append((row, doc_id, k, start, length, len(w), c, fresh))
                if not out:
                    continue
                keys = dict(zip(new, maker.of(list(new.values())).tolist())) if new else {}
                if len(told) > REMEMBER:
                    told.clear()
                told.update(new)
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array([keys[c] if f else None for c, f in zip(cols[6], cols[7])], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PLACES.split(", ")])

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each band of a class with the next one: sorted by it, classes that share both stand together in their bucket."""
    for b in batches:
        bands = b.column("bands").flatten().to_numpy().reshape(b.num_rows, -1)
        classes = np.repeat(b.column("class").to_numpy(), bands.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bands.ravel(), classes, np.roll(bands, -1, axis=1).ravel())], names=["band", "class", "next"])


def _texts(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                new = {}
                for t in b.column("text").slice(at, 512):
                    for *_, w in paragraphs(t.as_py(), min_words):
                        text = b" ".join(w)
                        c = signed(xxhash.xxh3_64_intdigest(text))
                        if c not in told:
                            told.add(c)
                            new[c] = text
                if len(told) > REMEMBER:
                    told.clear()
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.binary())], names=["class", "text"])

    return run


def shingles(text: bytes) -> set[bytes]:
    w = text.split(b" ")
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


def jaccard(a: bytes, b: bytes) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([jaccard(x, y) >= least for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(ok)

    return run


def shingle_hashes(text: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, shingles(text)), np.uint64)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 512):
            part = b.slice(k, 512)
            sets = [shingle_hashes(t) for t in part.column("text").to_pylist()]
            of = part.column("class").take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
            yield pa.RecordBatch.from_arrays([of, pa.array(np.concatenate(sets).view(np.int64))], names=["class", "shingle"])


#: Words of 64 bits in the map of a class's shingles.
MAP = 8
MAPPED = "class long, text binary, n int, " + ", ".join(f"m{k} long" for k in range(MAP))


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with the number of their shingles and a map of 64 * MAP bits that has a bit set for each."""
    for b in batches:
        n, maps = np.zeros(b.num_rows, np.int32), np.zeros((b.num_rows, 64 * MAP), bool)
        for i, t in enumerate(b.column("text").to_pylist()):
            h = shingle_hashes(t)
            n[i] = len(h)
            maps[i, (h >> np.uint64(40)) % np.uint64(64 * MAP)] = True
        words = np.packbits(maps, axis=1, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("class"), b.column("text"), pa.array(n), *map(pa.array, np.ascontiguousarray(words.T))], names=names(MAPPED))


def _can_be_alike(similarity: float, a: str, b: str) -> Column:
    """Whether two sets can reach a similarity, by their sizes and maps: each bit that one map has alone is a shingle that
    the other set lacks. Columns are n and m0, m1 ... with a prefix each."""
    def alone(x: str, y: str) -> Column:
        return reduce(add, [F.bit_count(F.col(f"{x}m{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}m{k}")))) for k in range(MAP)])

    shared = F.least(F.col(f"{a}n") - alone(a, b), F.col(f"{b}n") - alone(b, a))
    return shared * (1 + similarity) >= similarity * (F.col(f"{a}n") + F.col(f"{b}n")) - 1e-9


def prefixed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


#: Bins of set sizes, so many for a factor of e.
SIZE_BINS = 32


def _across(big: DataFrame, linked: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """u, v: pairs of a bucket in different components that can be alike, but for pairs of which neither is outside the
    bucket's largest one.

    A set of n shingles, u of them its own alone, shares n - u at most, so a set of m that is alike to it has
    m <= (n - u) * (1 + similarity) / similarity - n, and m >= similarity * n.
    """
    named = big.select("band", "class").join(linked.hint("merge"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = scratch.table(named, "named")
    kinds = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = kinds.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    mixed_ones = scratch.table(named.join(largest.hint("merge"), "band"), "mixed")
    able = texts.join(mixed_ones.select("class").distinct().hint("merge"), "class", "left_semi")
    sets = scratch.table(able.select("class", "text").mapInArrow(tidy(_shingle_rows), "class long, shingle long"), "sets")
    alone = sets.groupBy("shingle").agg(F.min("class").alias("class"), F.max("class").alias("other")).where("class = other").groupBy("class").agg(F.count(F.lit(1)).alias("alone"))
    slack = 1e-9
    most = F.floor((F.col("n") - F.coalesce("alone", F.lit(0))) * ((1 + similarity) / similarity) - F.col("n") + slack)
    sizes = able.drop("text").join(alone.hint("merge"), "class", "left").withColumns({"least": F.ceil(F.col("n") * similarity - slack), "most": F.least(most, F.floor(F.col("n") / similarity + slack))}).where("least <= most").drop("alone")
    able = scratch.table(mixed_ones.join(sizes.hint("merge"), "class"), "able")
    size_bin = lambda c: F.floor(F.log(F.col(c).cast("double")) * SIZE_BINS).cast("int")
    outside = able.where("component <> largest").withColumn("bin", F.explode(F.sequence(size_bin("least"), size_bin("most")))).drop("largest")
    a, b = prefixed(outside, "a_", "band", "bin"), prefixed(able.withColumn("bin", size_bin("n")).drop("largest"), "b_", "band", "bin")
    can = F.col("b_n").between(F.col("a_least"), F.col("a_most")) & F.col("a_n").between(F.col("b_least"), F.col("b_most"))
    met = a.hint("merge").join(b, ["band", "bin"]).where(can & (F.col("a_component") != F.col("b_component")) & _can_be_alike(similarity, "a_", "b_"))
    return met.select(F.greatest("a_class", "b_class").alias("u"), F.least("a_class", "b_class").alias("v")).distinct()


def repeated_paragraphs(docs: DataFrame, min_words: int = 20, similarity: float = 0.8, bands: int = 12, rows: int = 4, near: int = 8, hubs: int = 4) -> DataFrame:
    """row, doc_id, paragraph, start, length, n_words, cluster_id, n_places, first_doc_id, removed: every repeated paragraph."""
    scratch = Scratch(docs.sparkSession, "repeats")
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = scratch.table(source.mapInArrow(tidy(_places(min_words, bands, rows)), PLACES), "places")

    told = places.where("bands is not null").select("class", "bands").mapInArrow(tidy(_band_rows), "band long, class long, next long").repartition("band")
    # Most bands have one class; they go before anything is sorted.
    several = told.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("band")
    counted = told.join(several.hint("shuffle_hash"), "band", "left_semi").groupBy("band", "class", "next").agg(F.count(F.lit(1)).alias("n"))
    wide = Window.partitionBy("band").orderBy(F.desc("n"), "class").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    like = Window.partitionBy("band").orderBy("next", "class").rowsBetween(-near, -1)
    seen = counted.select("band", "class", F.count(F.lit(1)).over(wide).alias("size"), F.collect_list("class").over(like).alias("before"), F.array(*[F.nth_value("class", k + 1).over(wide) for k in range(hubs)]).alias("hubs"))
    shared = scratch.table(seen.where("size > 1"), "shared")
    met = shared.select(F.col("class").alias("a"), F.explode(F.array_compact(F.concat("before", "hubs"))).alias("b")).where("a <> b")
    pairs = scratch.table(met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")

    # The wanted classes grow with the documents, so the join is by shuffle at every size; the same shuffle serves the pick.
    wanted = scratch.table(shared.select("class").distinct(), "wanted")
    texts = docs.select("text").mapInArrow(tidy(_texts(min_words)), "class long, text binary").join(wanted.hint("merge"), "class", "left_semi").dropDuplicates(["class"])
    texts = scratch.table(texts.mapInArrow(tidy(_mapped), MAPPED), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        with_a = pairs.hint("merge").join(prefixed(texts, "a_").withColumnRenamed("a_class", "u"), "u")
        with_both = with_a.hint("merge").join(prefixed(texts, "b_").withColumnRenamed("b_class", "v"), "v").where(_can_be_alike(similarity, "a_", "b_"))
        return with_both.select("u", "v", F.col("a_text").alias("a"), F.col("b_text").alias("b")).mapInArrow(tidy(_verify(similarity)), "u long, v long")

    linked = scratch.table(connected_components(links(pairs), scratch).withColumnRenamed("node", "class"), "linked")
    rest = scratch.table(_across(shared.where(F.col("size") > near + 1), linked, texts, similarity, scratch), "rest")
    more = links(rest).join(linked.select(F.col("class").alias("u"), F.col("component").alias("p")), "u", "left").join(linked.select(F.col("class").alias("v"), F.col("component").alias("q")), "v", "left")
    joined = scratch.table(connected_components(more.select(F.coalesce("p", "u").alias("u"), F.coalesce("q", "v").alias("v")), scratch), "joined")
    # The first links' components, renamed where the second pass joined them; classes that only it linked come in by themselves.
    renamed = linked.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("class", F.coalesce("to", "component").alias("component"))
    fresh = joined.join(linked.select(F.col("class").alias("node")), "node", "left_anti").select(F.col("node").alias("class"), "component")
    linked = scratch.table(renamed.unionByName(fresh), "all_linked")
    scratch.drop(shared, pairs, wanted, texts, rest)

    clustered = scratch.table(places.drop("bands").join(linked, "class", "left").withColumn("cluster", F.coalesce("component", "class")).drop("class", "component"), "clustered")
    scratch.drop(places, linked)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"), F.col("paragraph").alias("paragraph"))
    found = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_places"), F.min(order).alias("first"), F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").drop("low", "high")
    found = scratch.table(found, "clusters")
    first = F.struct(F.col("row").alias("row"), F.col("paragraph").alias("paragraph")) == F.struct(F.col("first.row").alias("row"), F.col("first.paragraph").alias("paragraph"))
    return clustered.join(found, "cluster").select("row", "doc_id", "paragraph", "start", "length", "n_words", F.col("cluster").alias("cluster_id"), "n_places", F.col("first.doc_id").alias("first_doc_id"), (~first).alias("removed"))


def keep_first(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each cluster of texts alike as a whole: the smallest doc_id (null last, then by place in docs).

    Texts are compared like paragraphs, by the Jaccard similarity of their five-word shingles; those of under five words stay.
    """
    scratch = Scratch(docs.sparkSession, "alike")
    rows = scratch.table(docs.withColumn("_sl_row", F.monotonically_increasing_id()), "documents")
    whole = rows.select(F.col("_sl_row").alias("doc_id"), F.translate("text", "\n", " ").alias("text"))
    found = repeated_paragraphs(whole, SHINGLE, similarity).select(F.col("doc_id").alias("_sl_row"), "cluster_id")
    ids = rows.select("_sl_row", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), "_sl_row").alias("place"))
    placed = scratch.table(found.join(ids, "_sl_row"), "placed")
    first = placed.groupBy("cluster_id").agg(F.min("place").alias("first"))
    gone = placed.join(first, "cluster_id").where(F.col("_sl_row") != F.col("first._sl_row")).select("_sl_row")
    return rows.join(gone, "_sl_row", "left_anti").select(*docs.columns)


def sliding(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """f (minimum or maximum) over every n consecutive values, by doubling."""
    have = 1
    while 2 * have <= n:
        x, have = f(x[:-have], x[have:]), 2 * have
    return f(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def winnow(g: np.ndarray, span: int) -> np.ndarray:
    """Places of all values that are the least of some span consecutive ones; g has span values at least."""
    edge = np.zeros(span - 1, np.uint64)
    return np.flatnonzero(sliding(np.maximum, np.concatenate((edge, sliding(np.minimum, g, span), edge)), span) == g)


def grams_of(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every gram (half a window and a word long), and the places that winnowing picks."""
    g = runs_of(h, window // 2 + 1)
    return g, winnow(g, window - window // 2)


def _grams(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part, out = b.slice(k, 512), []
                for i, t in enumerate(part.column("text")):
                    _, h = word_hashes(t.as_py())
                    if len(h) >= window:
                        g, at = grams_of(h, window)
                        _, number, times = np.unique(g[at], return_inverse=True, return_counts=True)
                        out.append((np.full(len(at), i), g[at].view(np.int64), at.astype(np.int32), times[number] > 1))
                if out:
                    of, *cols = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(of)) for c in ("row", "doc_id")), *map(pa.array, cols)], names=names(GRAMS))

    return run


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Hits:
    """The hits of a batch of rows, as arrays: of (number of the row in the batch), at, gram, f_row, f_doc, f_at, more, twice, own."""

    def __init__(self, column: pa.ListArray, size: int):
        flat = column.flatten()
        n = np.diff(column.offsets.to_numpy())
        self.of = np.repeat(np.arange(len(column)), n)
        for k, field in enumerate(flat.type):
            if field.name != "f_doc":
                setattr(self, field.name, flat.field(k).to_numpy(zero_copy_only=False))
            else:
                self.f_doc = flat.field(k)
        # Chains: hits on one diagonal to the same first row that leave no word between them out.
        use = np.flatnonzero(~self.twice & ~self.own)
        d = self.at[use].astype(np.int64) - self.f_at[use]
        use = use[np.lexsort((self.at[use], d, self.f_row[use], self.of[use]))]
        d = self.at[use].astype(np.int64) - self.f_at[use]
        same = (self.of[use][1:] == self.of[use][:-1]) & (self.f_row[use][1:] == self.f_row[use][:-1]) & (d[1:] == d[:-1]) & (np.diff(self.at[use]) <= size)
        new = np.concatenate((np.ones(min(1, len(use)), bool), ~same))
        self.member, self.chain = use, np.cumsum(new) - 1
        self.first = use[new]
        self.last = use[np.concatenate((~same, np.ones(min(1, len(use)), bool)))]


def _contexts(window: int):
    """What stands beside grams: hashes of the words before and after, for first places and for both ends of every chain."""
    size, beside = window // 2 + 1, window - window // 2 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, 256) for x in batches for k in range(0, x.num_rows, 256)):
            hits = Hits(b.column("hits"), size)
            firsts = np.flatnonzero(hits.own & ~hits.twice)
            at = np.concatenate((firsts, hits.first, hits.last))
            # Ends of chains: even numbers for the front, odd ones for the back; -1 for first places.
            end = np.concatenate((np.full(len(firsts), -1), 2 * np.arange(len(hits.first)), 2 * np.arange(len(hits.last)) + 1))
            sides = np.empty((2, len(at), beside), np.uint32)
            order = np.argsort(hits.of[at], kind="stable")
            bounds = np.searchsorted(hits.of[at][order], np.arange(b.num_rows + 1))
            for i, t in enumerate(b.column("text")):
                k = order[bounds[i] : bounds[i + 1]]
                if not len(k):
                    continue
                # Real words have a bit set that the filling beyond a text's ends lacks; it differs for first places and others.
                h = (word_hashes(t.as_py())[1] >> np.uint64(32)).astype(np.uint32) | np.uint32(2)
                for fill, part in ((0, k[end[k] < 0]), (1, k[end[k] >= 0])):
                    pad = np.full(beside, fill, np.uint32)
                    x = np.concatenate((pad, h, pad))
                    place = hits.at[at[part]][:, None] + beside
                    sides[0, part] = x[place - 1 - np.arange(beside)]
                    sides[1, part] = x[place + size + np.arange(beside)]
            flat = [pa.array([y.tobytes() for y in side], pa.binary()) for side in sides]
            side = np.where(end < 0, -1, end % 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(hits.gram[at]), b.column("row").take(pa.array(hits.of[at])), pa.array(hits.at[at]), pa.array(hits.f_row[at]), pa.array(side), *flat], names=names(CONTEXTS))

    return run


def _reach(beside: int):
    """How many words beside an end of a chain the first place has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, other = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, beside) for c in ("words", "first_words"))
            differs = np.concatenate((ends != other, np.ones((len(ends), 1), bool)), axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "at", "f_row", "side")), pa.array(differs.argmax(axis=1).astype(np.int32))], names=["row", "at", "f_row", "side", "reach"])

    return run


def _spans(window: int):
    """Chains with all that they share with their first place (kind 0), and windows that can repeat elsewhere (kind 1).

    Chains are numbered within their row's batch, which can differ from pass to pass, so their ends come by word: reach has
    (row, place of the first or last gram of a chain, side).
    """
    size = window // 2 + 1
    span = window - size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, 256) for x in batches for k in range(0, x.num_rows, 256)):
            hits = Hits(b.column("hits"), size)
            known = np.zeros((len(hits.at), 2), np.int64)
            beyond = [{(x["at"], x["f_row"], x["side"]): x["reach"] for x in r or ()} for r in b.column("reach").to_pylist()]
            get = lambda k, side: beyond[hits.of[k]][int(hits.at[k]), int(hits.f_row[k]), side]
            a = np.array([hits.at[k] - get(k, 0) for k in hits.first.tolist()], np.int64)
            z = np.array([hits.at[k] + size + get(k, 1) for k in hits.last.tolist()], np.int64)
            known[hits.member, 0], known[hits.member, 1] = a[hits.chain], z[hits.chain]
            long = np.flatnonzero(z - a >= window)
            k = hits.first[long]
            rows = [b.column(c).take(pa.array(hits.of[k])) for c in ("row", "doc_id")]
            cols = [np.zeros(len(k), np.int32), *rows, a[long], z[long], np.zeros(len(k), np.int64), hits.f_row[k], hits.f_doc.take(pa.array(k)), a[long] - hits.at[k] + hits.f_at[k]]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, SPAN_TYPES)], names=names(SPANS))

            asked = np.flatnonzero(hits.twice | hits.more & ~hits.own)
            bounds = np.searchsorted(hits.of[asked], np.arange(b.num_rows + 1))
            out = []
            for i, t in enumerate(b.column("text")):
                mine = asked[bounds[i] : bounds[i + 1]]
                if not len(mine):
                    continue
                # A window belongs to the gram that winnowing picks from it.
                near = hits.at[mine].astype(np.int64)[:, None] - np.arange(span)
                inside = (near >= 0) & ~((near >= known[mine, :1]) & (near + window <= known[mine, 1:]))
                if not inside.any():
                    continue
                _, h = word_hashes(t.as_py())
                g = runs_of(h, size)
                low = sliding(np.minimum, g, span)
                inside &= near < len(low)
                near = np.where(inside, near, 0)
                inside &= low[near] == g[hits.at[mine]][:, None]
                s = np.unique(near[inside])
                if len(s):
                    out.append((np.full(len(s), i), s, runs_of(h, window)[s].view(np.int64)))
            if out:
                of, s, run_ = (np.concatenate(c) for c in zip(*out))
                none = pa.nulls(len(s))
                cols = [np.ones(len(s), np.int32), *(b.column(c).take(pa.array(of)) for c in ("row", "doc_id")), s, s + window, run_, none, none, none]
                yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(t) for c, t in zip(cols, SPAN_TYPES)], names=names(SPANS))

    return run


def _told(window: int):
    """Passages by words as spans of code points, with the line of their start and the hash of their first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc_id, t, found in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), b.column("found").to_pylist()):
                raw, h = word_hashes(t.as_py())
                x, starts, ends = word_places(raw)
                points = np.concatenate(([0], np.cumsum((x & 0xC0) != 0x80)))
                lines = np.concatenate(([0], np.cumsum(x == 10)))
                runs = runs_of(h, window).view(np.int64)
                rows = [(row, doc_id, int(lines[starts[f["a"]]]), int(points[starts[f["a"]]]), int(points[ends[f["z"] - 1]] - points[starts[f["a"]]]), f["z"] - f["a"], int(runs[f["a"]]), f["n_places"], f["f_doc"], f["removed"]) for f in found]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names(PASSAGES))

    return run


def islands(df: DataFrame, by: Sequence[str], a: str, z: str) -> DataFrame:
    """df with island: rows of the same by whose ranges from a to z overlap or touch have one number."""
    order = Window.partitionBy(*by).orderBy(a, z)
    before = F.max(z).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(F.col(a) <= before, 0).otherwise(1)).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """The columns of repeated_paragraphs for every passage of at least window words that another document has word by word.

    Lines don't matter: a passage can lie inside a line or run over many. Winnowing (of the grams of half a window and a
    word, the least of every window's) picks a gram from every window by the window's words alone, so a window that repeats
    has a gram that repeats. Every place of such a gram is compared with the gram's first place by (doc_id, row): neighbours
    on one diagonal make a chain, and the words beside its ends are compared until they differ. What a window shares with
    other places, but not with the first one, is found by counting such windows themselves; where two places are all, or a
    chain holds the window, there are none. So exactly the windows found in two documents or more are left, without a bound
    on their number.

    A passage is a longest run of words that stands in its first row too, which keeps it; others can remove it. Passages of
    one document with different first rows can overlap. cluster_id is the passage's first window, n_places the places of the
    same run (for the one that stays, of its most frequent part), paragraph the line of its start. Words are compared by hashes
    (64 bits; beside the ends of a chain 32).
    """
    size = window // 2 + 1
    beside = window - size
    scratch = Scratch(docs.sparkSession, "passages")
    source = scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "source")
    grams = scratch.table(source.mapInArrow(tidy(_grams(window)), GRAMS), "grams")
    # The first place by doc_id (null last); with equal ids any one, but the same for all three columns.
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    again = grams.groupBy("gram").agg(*[F.min_by(c, order).alias(f) for c, f in (("doc_id", "f_doc"), ("row", "f_row"), ("at", "f_at"))], F.min("row").alias("low"), F.max("row").alias("high"), (F.count(F.lit(1)) > 2).alias("more"), F.max("again").alias("twice"))
    again = scratch.table(again.where("low < high").drop("low", "high"), "again")
    own = ((F.col("row") == F.col("f_row")) & (F.col("at") == F.col("f_at"))).alias("own")
    hits = grams.select("row", "gram", "at").join(again.hint("shuffle_hash"), "gram").groupBy("row").agg(F.collect_list(F.struct("gram", "at", "f_doc", "f_row", "f_at", "more", "twice", own)).alias("hits"))
    held = scratch.table(source.join(scratch.table(hits, "hits").hint("merge"), "row"), "held")
    scratch.drop(source, grams, again)

    contexts = scratch.table(held.mapInArrow(tidy(_contexts(window)), CONTEXTS), "contexts")
    firsts = contexts.where("side < 0").select("gram", F.col("before").alias("f_before"), F.col("after").alias("f_after"))
    met = contexts.where("side >= 0").join(firsts.hint("shuffle_hash"), "gram")
    met = met.select("row", "at", "f_row", "side", F.when(F.col("side") == 0, F.col("before")).otherwise(F.col("after")).alias("words"), F.when(F.col("side") == 0, F.col("f_before")).otherwise(F.col("f_after")).alias("first_words"))
    reach = met.mapInArrow(tidy(_reach(beside)), "row long, at int, f_row long, side int, reach int").groupBy("row").agg(F.collect_list(F.struct("at", "f_row", "side", "reach")).alias("reach"))
    spans = scratch.table(held.join(scratch.table(reach, "reach").hint("merge"), "row", "left").mapInArrow(tidy(_spans(window)), SPANS), "spans")
    scratch.drop(contexts)

    single = spans.where("kind = 1").select("row", "doc_id", "a", "z", "run")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "a")
    shared = single.groupBy("run").agg(F.min(first).alias("f"), F.min("row").alias("low"), F.max("row").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("run", "f", "n")
    shared = scratch.table(shared, "shared")
    met = scratch.table(single.join(shared.hint("shuffle_hash"), "run").where("row <> f.row or a <> f.a"), "met")
    more = met.where("row <> f.row").select("row", "a", "z", F.col("f.row").alias("f_row"), F.col("f.doc_id").alias("f_doc"), F.col("f.a").alias("f_a"))
    # The first row can have such a window again; it keeps that one too.
    once_more = met.where("row = f.row").select(F.col("row").alias("f_row"), F.col("f.doc_id").alias("f_doc"), F.col("a").alias("f_a"), F.col("z").alias("f_z"), F.col("n").alias("n_places"))
    copies = spans.where("kind = 0").select("row", "a", "z", "f_row", "f_doc", "f_a").union(more).withColumn("d", F.col("a") - F.col("f_a"))
    key = ["row", "f_row", "f_doc", "d"]
    copies = islands(copies, key, "a", "z").groupBy(*key, "island").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    copies = scratch.table(copies.select("row", "f_row", "f_doc", "a", "z", (F.col("a") - F.col("d")).alias("f_a"), (F.col("z") - F.col("d")).alias("f_z")), "copies")
    places = scratch.table(copies.groupBy("f_row", "f_doc", "f_a", "f_z").agg((F.count(F.lit(1)) + 1).alias("n_places")), "places")
    removed = copies.join(places.drop("f_doc").hint("merge"), ["f_row", "f_a", "f_z"]).select("row", "a", "z", "f_doc", "n_places", F.lit(True).alias("removed"))
    # One range for each place where something begins, so that a row that is first for many has no more than its words.
    begun = places.select("f_row", "f_doc", "f_a", "f_z", "n_places").union(once_more).groupBy("f_row", "f_doc", "f_a").agg(F.max("f_z").alias("f_z"), F.max("n_places").alias("n_places"))
    kept = islands(begun, ["f_row"], "f_a", "f_z").groupBy("f_row", "f_doc", "island").agg(F.min("f_a").alias("a"), F.max("f_z").alias("z"), F.max("n_places").alias("n_places"))
    found = removed.union(kept.select(F.col("f_row").alias("row"), "a", "z", "f_doc", "n_places", F.lit(False).alias("removed")))
    found = scratch.table(found.groupBy("row").agg(F.collect_list(F.struct("a", "z", "f_doc", "n_places", "removed")).alias("found")), "found")
    return held.drop("hits").join(found.hint("merge"), "row").mapInArrow(tidy(_told(window)), PASSAGES)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of all documents that repeats in another document, and every passage of 50 words or more that does.

    A passage that is a paragraph too has a row of each kind.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_paragraphs(docs).unionByName(repeated_passages(docs)).drop("row")
