"""Class-based n-gram scores after Brown, with classes from distributed exchange clustering.

Every word of the training text gets its class by exchange: it goes where it raises the likelihood of class bigrams most.
The ``frequent`` most counted words do so in rounds: a pass over all training text counts, for each of them, the classes
before and after it; with these counts they are moved one after the other. All other words, however many, wait in a class
of their own during the rounds. Then each is moved once, by the counts of its own neighbours' classes against the class
bigrams that the rounds left, smoothed: a table of (word, class beside it, count), summed by word in Spark, so no word is outside
exchange and nothing but classes times classes has to be in one place. (Rounds over parts of the vocabulary with counts
frozen meanwhile are the published distributed form of exchange clustering.) At last class bigrams are counted anew over
all training text, now with the class of every word.

A text's probability is the product over its tokens of P(class | class before) and P(word | class). Counts and classes of
the ``known`` most counted words travel with the tasks; those of all others are joined, by place in their text.

Defined cases: a null text counts as empty and consists of the end token; a null doc_id is training text; an empty table
gives an empty result; without training text only smoothing is left; repeated rows are scored each; a very long text is one
row and its classes one byte a token; other columns are not read. Every class keeps room for one word that training lacks;
the probability of such a word is the sum over classes, and what follows it is the mean over the classes it can be in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, remainder, tidy

#: No word holds a space, so this stands for the end of a text in the table of counts.
END = b" "
FLUSH = 300_000
#: Texts are read and scored in slices of about so many bytes, a longer text by itself.
SLICE = 2 << 20
ADD = 0.5
READ = "row long, token binary, at int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, emitted double, path binary"
PATHS = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emitted double, path binary"
#: In a path, the place of a word that is looked up by a join. Classes are below it.
OPEN = 255


class Words:
    """The words of some texts: Arrow splits them and numbers the different ones, so that each is looked up once.

    words: the different ones, which stay in Arrow, as Python objects cost more than all else here; codes: their numbers in
    turn; of: the number of the text that each stands in.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        coded = lists.flatten().dictionary_encode()
        self.n = len(texts)
        self.words: pa.Array = coded.dictionary.cast(pa.binary())
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.of = np.repeat(np.arange(self.n), pc.list_value_length(lists).to_numpy())
        if (empty := pc.index(self.words, pa.scalar(b"", pa.binary())).as_py()) >= 0:  # what white space at the ends of a text leaves
            real = self.codes != empty
            self.codes, self.of = self.codes[real], self.of[real]
        self.sizes = np.bincount(self.of, minlength=self.n)

    def numbers(self, known: pa.Array) -> np.ndarray:
        """The place of each word in turn among the known ones; -1 where it has none."""
        return pc.index_in(self.words, value_set=known).fill_null(-1).to_numpy().astype(np.int64)[self.codes]

    def closed(self, values: np.ndarray, end: int) -> np.ndarray:
        """values in turn with end before the first text and after each one."""
        return np.concatenate(([end], np.insert(values, np.cumsum(self.sizes), end)))

    def places(self) -> np.ndarray:
        """Where each word stands in what closed() gives."""
        return np.arange(len(self.codes)) + 1 + self.of


def _slices(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Where slices of values begin and how many values each holds."""
    ends = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(values)]
    yield from ((a, z - a) for a, z in zip(cuts, cuts[1:]) if z > a)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Batches in slices of some texts, with their words."""
    for b in batches:
        texts = b.column("text").view(pa.string())
        for a, n in _slices(b.column("text")):
            yield b.slice(a, n), Words(texts.slice(a, n))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def summed() -> pa.Table:
        got = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"token": got.column("token"), "n": got.column("n_sum")})

    for _, x in sliced(batches):
        times = np.bincount(x.codes, minlength=len(x.words))
        at = np.flatnonzero(times)
        held.append(pa.table({"token": x.words.take(pa.array(at)), "n": pa.array(times[at], pa.int64())}))
        held.append(pa.table({"token": pa.array([END], pa.binary()), "n": pa.array([x.n], pa.int64())}))
        n += len(at) + 1
        if n > FLUSH * 2:
            held = [summed()]
            n = len(held[0])
            if n > FLUSH:
                yield from held[0].to_batches(max_chunksize=1 << 16)
                held, n = [], 0
    if held:
        yield from summed().to_batches(max_chunksize=1 << 16)


@dataclass
class Units:
    """words: the most counted words in order; the first ``frequent`` are units, all others are in the unit ``rest``."""

    words: list[bytes]
    counts: np.ndarray
    frequent: int

    def __post_init__(self):
        self.rest, self.end = self.frequent, self.frequent + 1
        self.n = self.frequent + 2
        self.known = pa.array(self.words, pa.binary())

    def of_numbers(self, k: np.ndarray) -> np.ndarray:
        """Units of words by their numbers."""
        return np.where((k >= 0) & (k < self.frequent), k, self.rest)


def _encode(units: Units, size: int = 1 << 20):
    """Blobs of unit numbers; every text is closed by the end unit, and so is the front of a blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate([held[0][:1], *(x[1:] for x in held)]).tobytes()], pa.binary())], names=["units"])

        for _, x in sliced(batches):
            held.append(x.closed(units.of_numbers(x.numbers(units.known)), units.end).astype(np.uint16))
            n += len(held[-1])
            if n >= size:
                yield told()
                held, n = [], 0
        if held:
            yield told()

    return run


def _contexts(class_of: np.ndarray, classes: int):
    """For each (unit, class): how often the class comes before and after the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(class_of) * classes
        before, after = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in batches:
            for blob in b.column("units"):
                u = np.frombuffer(blob.as_py(), np.uint16).astype(np.int64)
                c = class_of[u]
                before += np.bincount(u[1:] * classes + c[:-1], minlength=cells)
                after += np.bincount(u[:-1] * classes + c[1:], minlength=cells)
        at = np.flatnonzero(before + after)
        for k in range(0, len(at), 1 << 16):
            i = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(before[i]), pa.array(after[i])], names=["cell", "before", "after"])

    return run


def count_contexts(blobs: DataFrame, class_of: np.ndarray, classes: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    summed = blobs.mapInArrow(tidy(_contexts(class_of, classes)), "cell long, before long, after long").groupBy("cell").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    summed = scratch.table(summed, "contexts")
    got = summed.toArrow()
    scratch.drop(summed)
    out = np.zeros((2, len(class_of) * classes), np.int64)
    at = got.column("cell").to_numpy()
    out[0, at], out[1, at] = got.column("before").to_numpy(), got.column("after").to_numpy()
    return out[0].reshape(len(class_of), classes), out[1].reshape(len(class_of), classes)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def bigrams(after: np.ndarray, class_of: np.ndarray, classes: int) -> np.ndarray:
    n = np.zeros((classes, classes), np.int64)
    np.add.at(n, class_of, after)
    return n


def likelihood(n: np.ndarray) -> float:
    """Of class bigrams, up to a constant that classes don't change."""
    n = n.astype(float)
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=1)).sum() - _xlogx(n.sum(axis=0)).sum())


def exchange(before: np.ndarray, after: np.ndarray, class_of: np.ndarray, classes: int) -> np.ndarray:
    """One round of moves, the most counted units first. The last two units, all other words and the end, keep theirs."""
    out, n = class_of.copy(), bigrams(after, class_of, classes).astype(float)
    total, free = after.sum(axis=1), classes - 2
    for u in np.argsort(-total[:-2], kind="stable"):
        if not total[u]:
            break
        was, l, r = out[u], before[u].astype(float), after[u].astype(float)
        n[was] -= r
        n[:, was] -= l
        np.maximum(n, 0, out=n)
        rows, cols = n.sum(axis=1)[:free], n.sum(axis=0)[:free]
        gain = (_xlogx(n[:free] + r) - _xlogx(n[:free])).sum(axis=1) + (_xlogx(n[:, :free] + l[:, None]) - _xlogx(n[:, :free])).sum(axis=0)
        gain -= _xlogx(rows + r.sum()) - _xlogx(rows) + _xlogx(cols + l.sum()) - _xlogx(cols)
        now = int(np.argmax(gain))
        now = now if gain[now] > gain[was] + 1e-9 else was
        out[u] = now
        n[now] += r
        n[:, now] += l
    return out


def cluster(blobs: DataFrame, units: Units, classes: int, rounds: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit and the class bigrams under it. The last two classes are those of all other words and of the end."""
    # At first the most counted words are classes of their own, and the rest of the units are one class.
    class_of = np.full(units.n, classes - 3, np.int64)
    first = min(classes - 3, units.frequent)
    class_of[:first] = np.arange(first)
    class_of[units.rest], class_of[units.end] = classes - 2, classes - 1
    best = None
    for r in range(rounds + 1):
        before, after = count_contexts(blobs, class_of, classes, scratch)
        n = bigrams(after, class_of, classes)
        if best is None or likelihood(n) > best[0]:
            best = likelihood(n), class_of, n
        if r < rounds:
            class_of = exchange(before, after, class_of, classes)
    return best[1], best[2]


BESIDE = "id int, code int, n long, token binary, codes array<int>"


def _beside(units: Units, class_of: np.ndarray, classes: int):
    """What stands beside the words that are no units: code is the class before a word, or classes and the class after it.

    Known words come summed as (id, code, n), all others as (token, codes) by slice of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
        names = [c.split()[0] for c in BESIDE.split(", ")]

        def told() -> pa.RecordBatch:
            key, times = np.unique(np.concatenate(held), return_counts=True)
            cols = [pa.array((key // (2 * classes)).astype(np.int32)), pa.array((key % (2 * classes)).astype(np.int32)), pa.array(times), *(pa.nulls(len(key), t) for t in kinds[3:])]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for _, x in sliced(batches):
            k = x.numbers(units.known)
            path = x.closed(class_of[units.of_numbers(k)], class_of[-1])
            place = x.places()
            before, after = path[place - 1], classes + path[place + 1]
            at = k >= units.frequent
            held += [k[at] * (2 * classes) + before[at], k[at] * (2 * classes) + after[at]]
            n += len(held[-1])
            at = np.flatnonzero(k < 0)
            at = at[np.argsort(x.codes[at], kind="stable")]
            if len(at):
                word, first = np.unique(x.codes[at], return_index=True)
                pairs = np.stack((before[at], after[at]), axis=1).astype(np.int32).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.append(2 * first, len(pairs)).astype(np.int32)), pa.array(pairs))
                cols = [*(pa.nulls(len(word), t) for t in kinds[:3]), x.words.take(pa.array(word)), lists]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            if n > FLUSH * 4:
                yield told()
                held, n = [], 0
        if n:
            yield told()

    return run


def best_classes(starts: np.ndarray, codes: np.ndarray, times: np.ndarray, n: np.ndarray, prior: float = 50.0) -> np.ndarray:
    """The class that raises the likelihood most for each word; its (code, times) begin at starts. n: class bigrams.

    A word that joins a class with counts that don't change adds the logarithms of the shares that its neighbours have among
    the class's own, before and after. Shares are smoothed by those of all classes: else every word that joins a class
    of a few tokens, or an empty one, would seem to gain, and as all move at once they would all go there.
    """
    n, classes = n.astype(float), len(n)
    free = classes - 2
    # Row code, column class: how often the class follows the neighbour before, or the neighbour after follows the class.
    have = np.concatenate((n[:, :free], n.T[:, :free]))
    share = np.concatenate((n.sum(axis=1), n.sum(axis=0))) / max(n.sum(), 1.0)
    of = np.concatenate((np.tile(n.sum(axis=0)[:free], (classes, 1)), np.tile(n.sum(axis=1)[:free], (classes, 1))))
    gain = np.log((have + prior * share[:, None] + 1e-9) / (of + prior + 1e-9))
    out = np.zeros(len(starts), np.int64)
    for lo in range(0, len(starts), 4096):
        hi = min(len(starts), lo + 4096)
        a, z = starts[lo], starts[hi] if hi < len(starts) else len(codes)
        out[lo:hi] = np.add.reduceat(times[a:z, None] * gain[codes[a:z]], starts[lo:hi] - a, axis=0).argmax(axis=1)
    return out


def _moved(n: np.ndarray, key: str):
    """The class of each word of key, by x: structs of (code, times), or lists of codes that count once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x")
                starts = x.offsets.to_numpy() - x.offsets[0].as_py()
                flat = x.flatten()
                if pa.types.is_struct(flat.type):
                    codes, times = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                else:
                    inner = flat.offsets.to_numpy() - flat.offsets[0].as_py()
                    starts, codes = inner[starts], flat.flatten().to_numpy()
                    times = np.ones(len(codes), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(best_classes(starts[:-1], codes, times, n).astype(np.int32))], names=[key, "class"])

    return run


@dataclass
class Model:
    units: Units  # the known words
    class_of: np.ndarray  # of the known words
    classes: int
    word_total: float  # the denominator of the base
    class_total: np.ndarray  # the denominators of P(word | class)

    @property
    def unseen(self) -> int:
        """Stands in paths for words that training lacks."""
        return self.classes - 2


def _read(m: Model):
    """A row for each text, with the classes of its known words, and one for each place of another word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, counts, end = m.units, m.units.counts.astype(float), m.classes - 1
        base_of = np.log10((counts[:-1] + ADD) / m.word_total)
        emit_of = np.log10((counts[:-1] + ADD) / m.class_total[m.class_of])
        end_base, end_emit = (float(np.log10((counts[-1] + ADD) / x)) for x in (m.word_total, m.class_total[end]))
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        for b, x in sliced(batches):
            k = x.numbers(units.known)
            known = k >= 0
            sums = lambda v: np.bincount(x.of[known], v[k[known]], x.n)  # noqa: B023, E731
            path = np.full(len(k), OPEN, np.uint8)
            path[known] = m.class_of[k[known]]
            ends = np.cumsum(x.sizes)
            first = ends - x.sizes
            other = np.flatnonzero(~known)
            n = len(other)
            row = b.column("row")
            main = [row, pa.nulls(x.n, pa.binary()), pa.nulls(x.n, pa.int32()), b.column("doc_id"), b.column("held_out"), pa.array(x.sizes + 1), pa.array(np.bincount(x.of[known], minlength=x.n) + int(counts[-1] > 0))]
            main += [pa.array(sums(base_of) + end_base), pa.array(sums(emit_of) + end_emit), pa.array([path[a:z].tobytes() for a, z in zip(first.tolist(), ends.tolist())], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(main, kinds)], names=[c.split()[0] for c in READ.split(", ")])
            if n:
                words = x.words.take(pa.array(x.codes[other]))
                more = [row.take(pa.array(x.of[other])), words, pa.array((other - first[x.of[other]]).astype(np.int32))] + [pa.nulls(n, t) for t in kinds[3:]]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(more, kinds)], names=[c.split()[0] for c in READ.split(", ")])

    return run


def _filled(m: Model):
    """Paths with the classes of the words that were looked up; what these add to the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, paths = b.column("x"), b.column("path")
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(x).fill_null(0).to_numpy())
            at, kind, n = (x.flatten().field(j).to_numpy(zero_copy_only=False) for j in range(3))
            order = np.lexsort((at, of))  # sums don't depend on the order in which rows came
            of, at, kind, n = of[order], at[order], kind[order], n[order]
            starts = np.concatenate(([0], np.cumsum(pc.binary_length(paths).to_numpy()))).astype(np.int32)
            flat = np.frombuffer(bytearray().join(paths.to_pylist()), np.uint8)
            flat[starts[of] + at] = kind
            path = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(starts), pa.py_buffer(flat)])
            seen = n > 0
            emit = np.log10((n[seen] + ADD) / m.class_total[kind[seen]])
            n_known = b.column("n_known").to_numpy() + np.bincount(of[seen], minlength=b.num_rows)
            base = b.column("base").to_numpy() + np.bincount(of, np.log10((n + ADD) / m.word_total), b.num_rows)
            emitted = b.column("emitted").to_numpy() + np.bincount(of[seen], emit, b.num_rows)
            out = [b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), pa.array(n_known, pa.int64()), pa.array(base), pa.array(emitted), path]
            yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in PATHS.split(", ")])

    return run


def _steps(paths: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of paths: the classes that steps come from and go to, and where the steps of each path begin."""
    for a, n in _slices(paths):
        part = paths.slice(a, n)
        stops = np.cumsum(pc.binary_length(part).to_numpy())
        x = np.concatenate(([end], np.insert(np.frombuffer(b"".join(part.to_pylist()), np.uint8), stops, end)))
        yield x[:-1], x[1:], np.concatenate(([0], stops[:-1] + np.arange(1, n)))


def _bigrams(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(classes * classes, np.int64)
        for b in batches:
            for a, c, _ in _steps(b.column("path"), classes - 1):
                n += np.bincount(a * classes + c, minlength=classes * classes)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    return run


def _score(move: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            moved = [np.add.reduceat(move[a, c], starts) for a, c, starts in _steps(b.column("path"), len(move) - 1)]
            score = pa.array(np.concatenate([np.zeros(0), *moved]) + b.column("emitted").to_numpy(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base")), score], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def most_counted(vocabulary: DataFrame, known: int) -> list:
    """The most counted words, at most known: all above a bound on the count that a histogram by eighths of octaves gives.

    No task sends more to the driver than what is kept, however many tasks there are.
    """
    octave = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["o"]: r["c"] for r in vocabulary.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, held = None, 0
    for o in sorted(sizes, reverse=True):
        if held + sizes[o] > known:
            break
        least, held = o, held + sizes[o]
    if least is None:
        return []
    return sorted(vocabulary.where(octave >= least).collect(), key=lambda r: (-r["n"], bytes(r["token"])))


def word_classes(train: DataFrame, scratch: Scratch, classes: int = 48, rounds: int = 6, frequent: int = 8192, known: int = 200_000) -> tuple[DataFrame, Units, np.ndarray, np.ndarray]:
    """(token, n, class) of every word of train (text binary), the known words and their classes, and the class bigrams of the rounds.

    classes counts those of words; two more follow, that of all words that wait (empty in the end) and that of the end.
    """
    classes += 2
    if classes > OPEN or frequent > (1 << 16) - 2:
        raise ValueError("at most 253 classes and 65534 frequent words")
    vocabulary = scratch.table(train.mapInArrow(tidy(_count), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    top = most_counted(vocabulary.where(F.col("token") != F.lit(END)), known)
    ends = vocabulary.where(F.col("token") == F.lit(END)).first()
    counts = np.array([r["n"] for r in top] + [ends["n"] if ends else 0], np.int64)
    units = Units([bytes(r["token"]) for r in top], counts, min(frequent, len(top)))
    blobs = scratch.table(train.mapInArrow(tidy(_encode(units)), "units binary"), "units")
    class_of, n = cluster(blobs, units, classes, rounds, scratch)
    scratch.drop(blobs)
    beside = scratch.table(train.mapInArrow(tidy(_beside(units, class_of, classes)), BESIDE), "beside")
    known_ones = beside.where("id is not null").groupBy("id", "code").agg(F.sum("n").alias("times")).groupBy("id").agg(F.collect_list(F.struct("code", "times")).alias("x"))
    # The known words are bounded by parameter, so their classes are in one place.
    class_of_known = np.concatenate((class_of[: units.frequent], np.zeros(len(units.words) - units.frequent, np.int64)))
    got = known_ones.mapInArrow(tidy(_moved(n, "id")), "id int, class int").toArrow()
    class_of_known[got.column("id").to_numpy()] = got.column("class").to_numpy()
    rare = beside.where("token is not null").groupBy("token").agg(F.collect_list("codes").alias("x")).mapInArrow(tidy(_moved(n, "token")), "token binary, class int")
    core = train.sparkSession.createDataFrame(pa.table({"token": pa.array(units.words, pa.binary()), "class": pa.array(class_of_known, pa.int32())}))
    found = vocabulary.where(F.col("token") != F.lit(END)).join(rare.union(core).hint("merge"), "token")
    words = scratch.table(found.select("token", "n", "class"), "classes")
    scratch.drop(beside)
    return words, units, class_of_known, n


def transitions(n: np.ndarray, class_total: np.ndarray, prior: float) -> np.ndarray:
    """P(class | class before); in the last column but one P(unseen word | class before), in that row what follows such a word."""
    add = np.full(len(n), ADD)
    add[-2] = 0
    share = (n.sum(axis=0) + add) / (n.sum() + add.sum())
    move = (n + prior * share) / (n.sum(axis=1, keepdims=True) + prior)
    room = ADD / class_total
    room[-2:] = 0
    move[-2] = share * room @ move / (share * room).sum()
    move[:, -2] = move @ room
    return move


def score(docs: DataFrame, held_out: Column, classes: int = 48, rounds: int = 6, frequent: int = 8192, known: int = 200_000, prior: float = 5.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "brown")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    words, units, class_of, _ = word_classes(rows.where("not held_out").select("text"), scratch, classes, rounds, frequent, known)
    counts = units.counts
    classes += 2
    per = words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    total, distinct = sum(r["n"] for r in per) + int(counts[-1]), sum(r["words"] for r in per) + int(counts[-1] > 0)
    class_total = np.full(classes, ADD)
    for r in per:
        class_total[r["class"]] = r["n"] + ADD * (r["words"] + 1)
    class_total[-1] = counts[-1] + ADD
    model = Model(units, class_of, classes, total + ADD * (distinct + 1), class_total)

    read = scratch.table(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(tidy(_read(model)), READ), "read")
    other = read.where("token is not null").select("row", "token", "at").join(words.hint("merge"), "token", "left")
    looked = other.groupBy("row").agg(F.collect_list(F.struct("at", F.coalesce("class", F.lit(model.unseen)).alias("class"), F.coalesce("n", F.lit(0)).alias("n"))).alias("x"))
    met = read.where("token is null").drop("token", "at").join(looked, "row", "left")
    paths = scratch.table(met.mapInArrow(tidy(_filled(model)), PATHS), "paths")
    scratch.drop(read)
    n = np.zeros(classes * classes, np.int64)
    for r in paths.where("not held_out").select("path").mapInArrow(tidy(_bigrams(classes)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        n[r["cell"]] = r["n"]
    scored = paths.mapInArrow(_score(np.log10(transitions(n.reshape(classes, classes), class_total, prior))), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32 leaves 1 modulo 5 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, remainder(F.col("doc_id"), 5) == 1)
