"""Range kernels against nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import coverage, ordered, ranges


def intervals(n, seed, top=300):
    r = random.Random(seed)
    return [(r.choice("ab"), k, s, s + r.randint(0, 60)) for k, s in ((k, r.randint(0, top)) for k in range(n))]


@pytest.fixture(scope="module")
def two(spark):
    a, b = intervals(80, 1), intervals(70, 2)
    return a, b, spark.createDataFrame(a, "c string, i long, s long, e long"), spark.createDataFrame(b, "c string, j long, t long, f long")


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
def test_range_join_is_the_nested_loop_at_any_width(two, width):
    a, b, x, y = two
    got = sorted((r.i, r.j) for r in ranges.range_join(x, y, ["c"], ("s", "e"), ("t", "f"), width).collect())
    assert got == sorted((i, j) for c, i, s, e in a for d, j, t, f in b if c == d and s <= f and e >= t)


def test_contains_join_and_slack(two):
    a, b, x, y = two
    for slack in (0, 10):
        got = sorted((r.i, r.j) for r in ranges.contains_join(x, y, ["c"], ("s", "e"), ("t", "f"), 20, slack).collect())
        assert got == sorted((i, j) for c, i, s, e in a for d, j, t, f in b if c == d and t >= s - slack and f <= e + slack)


def test_point_join(two):
    a, b, x, y = two
    got = sorted((r.i, r.j) for r in ranges.point_join(x, y, ["c"], "s", ("t", "f"), 20).collect())
    assert got == sorted((i, j) for c, i, s, e in a for d, j, t, f in b if c == d and t <= s <= f)


def test_semi_anti_and_exactly(two):
    a, b, x, y = two
    hits = {i: sum(c == d and s <= f and e >= t for d, j, t, f in b) for c, i, s, e in a}
    ids = lambda **k: sorted(r.i for r in ranges.overlap_semi(x, y, ["c"], ("s", "e"), ("t", "f"), 20, ["i"], **k).collect())
    assert ids() == sorted(i for i, n in hits.items() if n)
    assert ids(anti=True) == sorted(i for i, n in hits.items() if not n)
    assert ids(anti=True, exactly=1) == sorted(i for i, n in hits.items() if n != 1)


def test_touching_ends_meet_and_nulls_don_t(spark):
    x = spark.createDataFrame([("a", 1, 5), ("a", None, 5), ("a", 9, 4)], "c string, s long, e long")
    y = spark.createDataFrame([("a", 5, 9)], "c string, t long, f long")
    assert ranges.range_join(x, y, ["c"], ("s", "e"), ("t", "f"), 3).count() == 1


def test_band_self_join(spark):
    rows = [(r[0], r[1], r[2]) for r in intervals(60, 3)]
    df = spark.createDataFrame(rows, "c string, i long, s long")
    got = sorted((r.a.i, r.b.i) for r in ranges.band_self_join(df, ["c"], "s", 10, "i").collect())
    assert got == sorted((i, j) for c, i, s in rows for d, j, t in rows if c == d and 0 <= t - s <= 10 and (t > s or j > i))


def islands(rows, slack=0, touching=True):
    out = {}
    for c in {r[0] for r in rows}:
        merged = []
        for s, e in sorted((s, e) for d, _, s, e in rows if d == c):
            if merged and (s <= merged[-1][1] + slack if touching else s < merged[-1][1] + slack):
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        out[c] = merged
    return out


@pytest.mark.parametrize("slack,touching", [(0, True), (0, False), (5, True)])
def test_merge_intervals(two, slack, touching):
    a, _, x, _ = two
    got = {}
    for r in ranges.merge_intervals(x, ["c"], ("s", "e"), slack, touching).collect():
        got.setdefault(r.c, []).append((r.start, r.end))
    assert {c: sorted(v) for c, v in got.items()} == islands(a, slack, touching)


def test_window_depth_is_the_depth_of_each_place(two):
    a, _, x, _ = two
    got = {(r.c, r.window): r.max_depth for r in coverage.window_max_depth(x, ["c"], "s", "e", 10).collect()}
    want = {}
    for c in "ab":
        for p in range(0, 400):
            d = sum(1 for q, _, s, e in a if q == c and s <= p < e)
            if d:
                want[c, p // 10] = max(want.get((c, p // 10), 0), d)
    assert got == want


def test_coverage_fixture(spark):
    df = spark.createDataFrame([("x", 0, 10), ("x", 5, 15)], "c string, s long, e long")
    assert sorted((r.window, r.max_depth) for r in coverage.window_max_depth(df, ["c"], "s", "e", 10).collect()) == [(0, 2), (1, 1)]


def test_median_depth(spark):
    df = spark.createDataFrame([("x", 0, 4), ("x", 2, 6)], "c string, s long, e long")
    region = spark.createDataFrame([("x", 1, 0, 7)], "c string, k int, lo long, hi long")
    # Depths of 0..6 are 1 1 2 2 1 1 0; sorted, the element 7 // 2 is 1.
    assert coverage.median_depth(df, ["c"], "s", "e", region, "k", ("lo", "hi")).first().median_depth == 1


def test_sessions(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 3, 10, 12, 30)], "c string, t long")
    assert [r.session for r in ranges.sessions(df, ["c"], "t", 5).orderBy("t").collect()] == [1, 1, 2, 2, 3]


def capacity(rows, cap):
    taken, out = [], {}
    for i, s, e, v in sorted(rows, key=lambda r: (-r[3], r[0])):
        ok = all(sum(a <= p <= b for a, b in taken) < cap for p in range(s, e + 1))
        out[i] = ok
        if ok:
            taken.append((s, e))
    return out


@pytest.mark.parametrize("cap", [1, 2])
def test_capacity_is_that_of_every_place(spark, cap):
    r = random.Random(cap)
    rows = [(i, s, s + r.randint(0, 15), r.randint(0, 9)) for i, s in enumerate(r.choices(range(120), k=60))]
    df = spark.createDataFrame([("k", *x) for x in rows], "c string, i long, s long, e long, v long")
    got = {x.i: x.accepted for x in ordered.accept_by_capacity(df, ["c"], "s", "e", "v", ["i"], cap).collect()}
    assert got == capacity(rows, cap)


def test_insert_while_querying(spark):
    r = random.Random(5)
    rows = [(i, s, s + r.randint(0, 8), r.random()) for i, s in enumerate(r.choices(range(100), k=50))]
    df = spark.createDataFrame([("k", *x) for x in rows], "c string, i long, s long, e long, v double")
    got = {x.i: x.blocked_by for x in ordered.insert_while_querying(df, ["c"], "s", "e", ["v", "i"]).collect()}
    taken = []
    for i, s, e, v in sorted(rows, key=lambda x: (x[3], x[0])):
        n = sum(a <= e and b >= s for a, b in taken)
        assert got[i] == n
        if not n:
            taken.append((s, e))


def test_anchored_chain_is_bounded_by_its_first_row(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 4, 8, 12, 30)], "c string, t long")
    assert [r.chain for r in ordered.anchored_chains(df, ["c"], "t", 10).orderBy("t").collect()] == [0, 0, 0, 12, 30]


def test_greedy_pairs(spark):
    p = spark.createDataFrame([("k", 1, 1, 5), ("k", 1, 2, 1), ("k", 2, 2, 2), ("k", 3, 1, 7)], "c string, a long, b long, cost long")
    got = {(r.a, r.b) for r in ordered.greedy_pairs(p, ["c"], "a", "b", "cost").where("accepted").collect()}
    assert got == {(1, 2), (3, 1)}


def test_results_do_not_depend_on_partitions(spark, two):
    _, _, x, _ = two
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, ordered.accept_by_capacity(x.withColumn("v", F.col("i") % 7), ["c"], "s", "e", "v", ["i"], 2).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
