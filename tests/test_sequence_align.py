"""Sequence functions and alignment against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import align, numeric, sequence
from spanloom.plans import assembly

DNA = st.text("ACGT", max_size=12)


def affine(a, b, s, local):
    """Gotoh's recurrences cell by cell."""
    low = -(10**9)
    n, m = len(a), len(b)
    h = [[0 if local else low] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    f = [[low] * (m + 1) for _ in range(n + 1)]
    h[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                f[i][j] = max(h[i - 1][j] - s.open, f[i - 1][j] - s.extend)
            if j:
                e[i][j] = max(h[i][j - 1] - s.open, e[i][j - 1] - s.extend)
            best = max(e[i][j], f[i][j], 0 if local or (i, j) == (0, 0) else low)
            if i and j:
                best = max(best, h[i - 1][j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch))
            h[i][j] = best
    return max(map(max, h)) if local else h[n][m]


@settings(max_examples=150, deadline=None)
@given(DNA, DNA)
def test_local_and_global_scores(a, b):
    s = align.Scoring(2, -3, 4, 1)
    found = align.align(a, b, s)
    assert (found.score if found else 0) == (affine(a, b, s, True) if a and b else 0)
    whole = align.align(a, b, s, "global")
    if a and b:
        assert whole.score == affine(a, b, s, False)


@settings(max_examples=100, deadline=None)
@given(DNA, DNA)
def test_an_alignment_has_the_score_that_it_states(a, b):
    s = align.Scoring(2, -3, 4, 1)
    for mode in ("local", "global", "semiglobal"):
        x = align.align(a, b, s, mode)
        if x is None:
            continue
        score, i, j = 0, x.q_start, x.r_start
        for op, n in x.ops:
            if op == "M":
                score += sum(s.match if a[i + k] == b[j + k] else s.mismatch for k in range(n))
                i, j = i + n, j + n
            else:
                score -= s.open + (n - 1) * s.extend
                i, j = (i + n, j) if op == "I" else (i, j + n)
        assert (i, j) == (x.q_end, x.r_end) and score == x.score
        # A gap of the query behind its last base belongs to no prefix.
        if not x.ops or x.ops[-1][0] != "D":
            assert align.prefix_scores(a, b, x, s)[x.q_end] == score


@settings(max_examples=100, deadline=None)
@given(DNA, DNA)
def test_edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        d = _row(d, i, c, b)
    assert align.edit_distance(a, b) == d[-1]


def _row(d, i, c, b):
    out = [i]
    for j, x in enumerate(b, 1):
        out.append(min(d[j] + 1, out[-1] + 1, d[j - 1] + (c != x)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=6), st.text("ACGT", max_size=20))
def test_best_placement(q, r):
    want = min(((sum(x != y for x, y in zip(q, r[k:])), k) for k in range(len(r) - len(q) + 1)), default=None)
    assert align.best_placement(q, r) == (None if want is None else want[::-1])


def test_overlaps():
    assert align.overlap("AAACGT", "CGTTT", 2) == (3, 0)
    assert align.overlap("AAACGT", "CGATT", 3, 0.4) == (3, 1)
    assert align.overlap("AAACGT", "CGATT", 3, 0.4, [40] * 6, [40] * 5) is None
    assert align.unique_perfect("AC", "GACG", 0, 4) == 1 and align.unique_perfect("AC", "ACAC", 0, 4) is None


def test_junction_of_a_deletion():
    r = random.Random(1)
    ref = "".join(r.choice("ACGT") for _ in range(200))
    kind, start, end, ins = align.junction(ref[50:90] + ref[130:170], ref)
    assert kind == "DEL" and sequence.left_align(ref, start, end)[:2] == sequence.left_align(ref, 89, 129)[:2]


@settings(max_examples=150, deadline=None)
@given(st.text("AC", min_size=8, max_size=20), st.integers(0, 6), st.integers(0, 4), st.text("AC", max_size=3))
def test_left_align_keeps_the_result(ref, start, size, ins):
    end = min(start + size, len(ref) - 1)
    done = lambda s, e, i: ref[: s + 1] + i + ref[e + 1 :]
    s, e, i = sequence.left_align(ref, start, end, ins)
    assert done(s, e, i) == done(start, end, ins) and s <= start
    s, e, i = sequence.trim_shared(ref, start, end, ins)
    assert done(s, e, i) == done(start, end, ins)
    parts = sequence.atoms(ref, start, end, ins)
    assert sequence.edited(ref, 0, len(ref), parts) == done(start, end, ins)


def test_sequence_columns(spark):
    df = spark.createDataFrame([("AACGGGT",), ("",), ("TTTTT",)], "s string")
    s = F.col("s")
    got = df.select(sequence.reverse_complement(s), sequence.longest_run(s), sequence.prefix_run(s), sequence.suffix_run(s), sequence.mostly_one_base(s), F.size(sequence.kmers(s, 3))).collect()
    assert [tuple(r) for r in got] == [("ACCCGTT", 3, 2, 1, False, 5), ("", 0, 0, 0, False, 0), ("AAAAA", 5, 5, 5, True, 3)]
    x = spark.range(1).select(F.lit("ABCD").alias("s")).select(sequence.rotated(F.col("s"), F.lit(1)), sequence.strip_twin(F.lit("x_DUP")), sequence.cigar_string(sequence.parse_cigar(F.lit("3S10M2D")))).first()
    assert tuple(x) == ("BCDA", "x", "3S10M2D")


def test_repeats_of_a_sequence():
    assert sequence.homopolymers("ACCCCCCT") == [(1, 7)] and sequence.dinucleotides("TACACACACG") == [(1, 9)]
    assert sequence.microhomology("GACTGACTG", 0, 4) == 5


def test_numbers(spark):
    v = lambda c: spark.range(1).select(c).first()[0]
    p = lambda x: v(numeric.piecewise(F.lit(float(x)), F.lit(4.0), F.lit(10.0)))
    assert p(4) == pytest.approx(0.25) and p(10) == pytest.approx(1.0) and p(-10) == pytest.approx(-1.0) and p(20) == pytest.approx(1.25)
    assert v(numeric.quantised(F.lit(0.0625), 0.025)) == pytest.approx(0.05)
    assert v(numeric.welch_z(F.lit(3.0), F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(0.0), F.lit(2.0))) == 2.0
    import numpy as np

    a = np.array([[1.0, 1.0], [0.0, 1.0]])
    assert numeric.nnls(a, np.array([1.0, 2.0])) == pytest.approx([0, 1.5])
    assert numeric.correction_posterior(np.array([20, 0, 0, 0]), np.zeros(4)).argmax() == 0


def test_assembly():
    r = random.Random(3)
    genome = "".join(r.choice("ACGT") for _ in range(200))
    reads = [genome[k : k + 40] for k in range(0, 161, 10)]
    assert assembly.assemble(reads, 15) == [genome]
    assert assembly.extended(genome[:40], reads, 15, 500) == genome
    noisy = genome[:100] + ("A" if genome[100] != "A" else "C") + genome[101:]
    assert assembly.polished(noisy, reads) == genome
    assert assembly.joined_flanks("AAACCC", "CCCGGG", 3) == "AAACCCGGG" and assembly.joined_flanks("AAA", "GGG", 2) == "AAA-GGG"


def test_cycles_are_broken_at_the_weakest_edge():
    edges = [[(1, 5, 5)], [(2, 4, 4)], [(0, 9, 9)]]
    out = assembly.break_cycles(edges)
    assert out == [[(1, 5, 5)], [], [(0, 9, 9)]]
    with pytest.raises(ValueError):
        assembly.longest_path(edges)


def test_phasing():
    assert assembly.phase([(0, 1, 8, 0), (1, 2, 0, 9), (0, 2, 5, 1), (2, 3, 2, 1)], 4) == [(0, 0), (0, 0), (0, 1), (3, 0)]
