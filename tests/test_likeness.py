"""Sessions of variants compared form by form, against the tables of all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph
from spanloom.plans import likeness, variants

V = "id string, sample string, chr string, start long, end long, svtype string, ins_seq string, gt array<int>, epr double, imprecise boolean, filters array<string>, consistent_reads int"


def some(n, seed, width=3000, ids=None, chrs=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        kind = r.choice(["DEL", "DUP", "INS", "INS", "INV"])
        s, size = r.randrange(width // 10) * 10, r.choice([60, 120, 180, 200, 240, 700])
        ins = r.choice(["A" * size, "A" * (size // 2) + "-" + "C" * 20]) if kind == "INS" else r.choice(["", None, "ACGT"])
        e = s if kind == "INS" else s + size
        if r.random() < 0.02:
            e = None
        gt = r.choice([[0, 1], [1, 1], [None, 1], [None, None], None])
        rows.append((f"v{r.randrange(ids) if ids else k}", f"s{k % 3}", r.choice([f"c{x}" for x in range(chrs)] + [None]), s, e, kind, ins, gt, r.choice([None, 0.25, 0.5, 0.75, r.random()]), r.choice([True, False, None]), [], r.choice([None, 1, 2])))
    return rows


def hits(df, found, key):
    ids = {r[key] for r in found}
    out = {}
    for r in df.collect():
        out.setdefault(r.svtype, [0, 0])[r.id not in ids] += 1
    return out


@pytest.mark.parametrize("seed", range(2))
def test_compare_matches_sessions_without_a_table_of_pairs(spark, monkeypatch, seed):
    a, b = (spark.createDataFrame(some(400, 10 * seed + k), V) for k in range(2))
    pairs = variants.candidate_pairs(a, b, variants.Match())
    ranked = pairs.select("chr", F.col("a.id").alias("x"), F.col("b.id").alias("y"), variants.match_order(b.columns).alias("o")).orderBy(F.desc("o"), "x", "y").collect()
    found: list[dict] = []
    used: tuple[set, set] = set(), set()
    for r in ranked:
        if r.x not in used[0] and r.y not in used[1]:
            used[0].add(r.x)
            used[1].add(r.y)
            found.append({"x": r.x, "y": r.y})
    monkeypatch.setattr(variants, "candidate_pairs", lambda *a, **k: pytest.fail("pairs are listed"))
    got = {r.svtype: r for r in variants.compare(a, b).collect()}
    x, y = hits(a, found, "x"), hits(b, found, "y")
    assert {k: [r.b_tp, r.fn] for k, r in got.items()} == x and {k: [r.c_tp, r.fp] for k, r in got.items()} == y
    assert sum(v[0] for v in x.values()) > 100


@pytest.mark.parametrize("seed", range(20))
def test_cliques_of_forms_are_those_of_rows(seed):
    rows = [(s, e, kind, ins or "", bool(imp)) for _, _, _, s, e, kind, ins, _, _, imp, *_ in some(160, seed, width=4000) if e is not None]
    rows = sorted(rows + rows[: 20 * (seed % 4)], key=lambda r: r[:3])
    names = ("start", "end", "svtype", "ins_seq", "imprecise")
    dicts = [dict(zip(names, r)) for r in rows]
    m = variants.Match()
    linked = lambda a, b: abs(rows[a][0] - rows[b][0]) <= 500 and variants._compatible(dicts[a], dicts[b], m)
    near = [[j for j in range(len(rows)) if j != i and linked(i, j)] for i in range(len(rows))]
    want = [0] * len(rows)
    for k, members in enumerate(sorted(map(sorted, graph.greedy_cliques(len(rows), linked, near)))):
        for i in members:
            want[i] = k
    assert likeness.cliques(m, 500, *map(list, zip(*rows))) == want


def test_cohort_takes_many_copies_of_a_form(spark):
    # 6,000 copies of four forms that are all within reach: 18 million pairs of rows.
    rows = [(f"v{k}", f"s{k % 3}", "c", 100 + k % 4, 400 + k % 4, "DEL", "", [0, 1], 0.5, False, [], 1) for k in range(6000)]
    t = time.monotonic()
    got = variants.cohort(spark.createDataFrame(rows, V), ["s0", "s1", "s2"]).collect()
    assert [(r.n_samples, r.n_calls) for r in got] == [(3, 6000)] and time.monotonic() - t < 30
