"""Functions of nucleotide strings: columns where expressions can say it, Python where a loop is needed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGTacgt", "TGCAtgca")


def reversed_complement(s: str) -> str:
    return s.translate(_COMPLEMENT)[::-1]


def oriented(s: Column, reverse: Column) -> Column:
    """A read as it was sequenced."""
    return F.when(reverse, reverse_complement(s)).otherwise(s)


def base_count(s: Column, base: str) -> Column:
    return (F.length(s) - F.length(F.translate(s, base, ""))).cast("long")


def composition(s: Column, prefix: str = "n_") -> list[Column]:
    return [base_count(s, b).alias(f"{prefix}{b.lower()}") for b in "ACGT"]


def flank(s: Column, at: Column, width: int, before: bool) -> Column:
    """The width bases before or after a 0-based place, fewer at the ends."""
    lo = F.greatest(at - width, F.lit(0)) if before else at
    return F.substr(s, (lo + 1).cast("int"), (at - lo if before else F.lit(width)).cast("int"))


def runs(s: Column) -> Column:
    """The runs of equal characters, in order."""
    return F.regexp_extract_all(s, F.lit(r"(?s)((.)\2*)"), F.lit(1))


def longest_run(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(runs(s), F.length)), F.lit(0)).cast("long")


def mostly_one_base(s: Column, share: float = 0.8) -> Column:
    most = F.greatest(*[base_count(s, b) for b in "ACGT"])
    return (F.length(s) > 0) & (most >= share * F.length(s))


def prefix_run(s: Column) -> Column:
    """Length of the run that a sequence begins with; suffix_run: ends with."""
    return F.length(F.regexp_extract(s, r"(?s)^((.)\2*)", 1)).cast("long")


def suffix_run(s: Column) -> Column:
    return prefix_run(F.reverse(s))


def cigar_string(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def parse_cigar(s: Column) -> Column:
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    return F.zip_with(F.regexp_extract_all(s, pattern, F.lit(1)), F.regexp_extract_all(s, pattern, F.lit(2)), lambda n, op: F.struct(op.alias("op"), n.cast("int").alias("len")))


def kmers(s: Column, k: int) -> Column:
    """All substrings of length k in order; none of a shorter sequence. One pass: a look-ahead matches at every place."""
    return F.regexp_extract_all(s, F.lit(rf"(?s)(?=(.{{{k}}}))"), F.lit(1))


def shared_kmers(a: Column, b: Column, k: int) -> Column:
    """Share of a's different k-mers that b has."""
    x = F.array_distinct(kmers(a, k))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, kmers(b, k))) / F.size(x))


def repeated_units(s: Column, unit: int, least: int) -> Column:
    """Stretches of at least ``least`` repeats of one unit of so many characters, in order."""
    return F.regexp_extract_all(s, F.lit(rf"((.{{{unit}}})\2{{{least - 1},}})"), F.lit(1))


def strip_twin(id_: Column) -> Column:
    return F.regexp_replace(id_, "_DUP$", "")


def alt_allele(ref: Column, start: Column, end: Column, ins: Column, pad: int) -> Column:
    """Reference with start+1..end (0-based, end included) replaced by ins, and pad bases on both sides."""
    lo = F.greatest(start + 1 - pad, F.lit(0))
    return F.concat(F.substr(ref, (lo + 1).cast("int"), (start + 1 - lo).cast("int")), F.coalesce(ins, F.lit("")), F.substr(ref, (end + 2).cast("int"), F.lit(pad)))


def rotated(s: Column, k: Column) -> Column:
    """A tandem sequence begun k characters later."""
    k = F.pmod(k, F.greatest(F.length(s), F.lit(1))).cast("int")
    return F.concat(F.substr(s, k + 1, F.length(s) - k), F.substr(s, F.lit(1), k))


def homopolymers(s: str, least: int = 5) -> list[tuple[int, int]]:
    """Half-open ranges of runs of at least so many bases."""
    return [m.span() for m in re.finditer(rf"([ACGT])\1{{{least - 1},}}", s)]


def dinucleotides(s: str, least: int = 4) -> list[tuple[int, int]]:
    """Half-open ranges of at least so many repeats of a unit of two different bases."""
    return [m.span() for m in re.finditer(rf"([ACGT])(?!\1)([ACGT])(?:\1\2){{{least - 1},}}", s)]


def microhomology(ref: str, start: int, end: int, cap: int = 1000) -> int:
    """How far a deletion of start+1..end can be shifted right and left without changing the result."""
    right = 0
    while right < cap and end + 1 + right < len(ref) and right < end - start and ref[start + 1 + right] == ref[end + 1 + right]:
        right += 1
    left = 0
    while left < cap and start - left >= 0 and left < end - start and ref[start - left] == ref[end - left]:
        left += 1
    return min(cap, left + right)


def left_align(ref: str, start: int, end: int, ins: str = "") -> tuple[int, int, str]:
    """The leftmost equal form of a change that puts ins in place of start+1..end (0-based, the base at start is kept).

    Pure deletions, pure insertions and duplications (an insertion of the span) are shifted; mixed ones are not.
    """
    if ins and end > start:
        return start, end, ins
    while start > 0:
        if not ins and ref[start] == ref[end]:
            start, end = start - 1, end - 1
        elif ins and ref[start] == ins[-1]:
            ins, start, end = ref[start] + ins[:-1], start - 1, end - 1
        else:
            break
    return start, end, ins


def trim_shared(ref: str, start: int, end: int, ins: str) -> tuple[int, int, str]:
    """A change without what its removed and inserted sequences share at the end, then at the front."""
    while ins and end > start and ref[end] == ins[-1]:
        end, ins = end - 1, ins[:-1]
    while ins and end > start and ref[start + 1] == ins[0]:
        start, ins = start + 1, ins[1:]
    return start, end, ins


def edited(ref: str, lo: int, hi: int, edits: list[tuple[int, int, str]]) -> str:
    """ref[lo:hi] with changes (start, end, ins) applied, each as in left_align; changes that reach outside are an error."""
    out, at = [], lo
    for start, end, ins in sorted(edits):
        if start + 1 < at or end + 1 > hi:
            raise ValueError("changes overlap or leave the window")
        out += [ref[at : start + 1], ins]
        at = end + 1
    return "".join([*out, ref[at:hi]])


def atoms(ref: str, start: int, end: int, ins: str, limit: int = 70) -> list[tuple[int, int, str]]:
    """A mixed change as single mismatches and gaps of its best global alignment; longer ones than limit stay whole."""
    from .align import global_ops

    old = ref[start + 1 : end + 1]
    if not old or not ins or max(len(old), len(ins)) > limit:
        return [(start, end, ins)]
    out, i, j = [], 0, 0
    for op, n in global_ops(old, ins):
        if op == "M":
            for k in range(n):
                if old[i + k] != ins[j + k]:
                    out.append((start + i + k, start + i + k + 1, ins[j + k]))
            i, j = i + n, j + n
        elif op == "D":
            out.append((start + i, start + i + n, ""))
            i += n
        else:
            out.append((start + i, start + i, ins[j : j + n]))
            j += n
    return out
