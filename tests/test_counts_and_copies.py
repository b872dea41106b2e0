"""Counts without lists, copies without all their pairs, and room for calls by lanes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import ordered, ranges
from spanloom.plans import domain, evidence, reads, variants

PAIRS = "qname string, contig string, lo long, hi long, outward boolean, discordant boolean"


def made(spark, seed):
    r = random.Random(seed)
    at = lambda: r.choice([r.randrange(3000), 1000, 1500, None]) if r.random() < 0.2 else r.randrange(3000)
    p, v = [], []
    for k in range(400):
        lo = at()
        p.append((r.choice([f"q{k}", f"q{k % 40}", None]), r.choice(["x", "y", None]), lo, None if lo is None or r.random() < 0.05 else lo + r.randrange(0, 1500), r.choice([True, False, None]), r.random() < 0.7))
    for k in range(80):
        s = at()
        v.append((k % 70, r.choice(["x", "y", None]), s, None if s is None else s + r.randrange(0, 1200)))
    return spark.createDataFrame(p, PAIRS), spark.createDataFrame(v, "id long, contig string, start long, end long")


def test_duplication_counts_list_no_pair(spark, monkeypatch):
    p, v = made(spark, 1)
    want = {(r.sv_id, r.label): r["n"] for r in reads.duplication_labels(p, v, width=400).groupBy("sv_id", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    monkeypatch.setattr(ranges, "range_join", lambda *a, **k: pytest.fail("pairs are listed"))
    got = {(r.sv_id, r.label): r["n"] for r in reads.duplication_counts(p, v, width=400).collect()}
    assert got == want and {x for _, x in got} == {"alt", "ref", "neutral"}


def test_stray_pairs_count_names_once(spark):
    p, v = made(spark, 2)
    met = p.where("discordant").join(v, "contig").where("lo between start - 300 and end + 300 and not (lo <= start and hi >= end)")
    want = {r.id: r["n"] for r in met.groupBy("id").agg(F.count_distinct("qname").alias("n")).collect()}
    assert {r.sv_id: r["n"] for r in reads.stray_pairs(p, v, 300, width=400).collect()} == want and len(want) > 20


def test_stray_pairs_are_many_around_one_variant(spark):
    # 40,000 pairs by 2,000 variants in one place: 80 million rows if they were listed.
    p = spark.range(40000).select(F.concat(F.lit("q"), "id").alias("qname"), F.lit("x").alias("contig"), (F.col("id") % 100 + 1000).alias("lo"), F.lit(1200).cast("long").alias("hi"), F.lit(True).alias("discordant"))
    v = spark.range(2000).select("id", F.lit("x").alias("contig"), (F.col("id") % 50 + 950).alias("start"), F.lit(1300).cast("long").alias("end"))
    t = time.monotonic()
    got = reads.stray_pairs(p, v, 300, width=1000).agg(F.count(F.lit(1)), F.sum("n")).first()
    assert tuple(got) == (2000, 80_000_000) and time.monotonic() - t < 30


def test_tracks_meet_what_overlaps():
    r = random.Random(3)
    tracks, rows = ordered.Tracks(), []
    for k in range(400):
        s = r.randrange(500)
        e = s + r.choice([-2, 0, 1, 5, 80])
        assert tracks.meet(s, e) == [j for j, (a, b) in enumerate(rows) if a <= e and b >= s]
        tracks.add(s, e, k)
        rows.append((s, e))


def test_deduplicate_compares_forms(spark, monkeypatch):
    from test_likeness import V, some

    v = spark.createDataFrame(some(300, 5, ids=280), V)
    pairs = variants.candidate_pairs(v, v, variants.Match()).where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.coalesce("a.imprecise", F.lit(False)).alias("i"), F.coalesce("b.imprecise", F.lit(False)).alias("j"), F.col("a.epr").alias("x"), F.col("b.epr").alias("y"))
    lost = {r.a if r.i else r.b for r in pairs.where("i <> j").collect()} | {r.b if r.x > r.y else r.a for r in pairs.where("i = j and x <> y").collect()}
    monkeypatch.setattr(variants, "candidate_pairs", lambda *a, **k: pytest.fail("pairs are listed"))
    assert sorted(r.id for r in variants.deduplicate(v).collect()) == sorted(r.id for r in v.collect() if r.id not in lost)


def test_read_overlaps_broadcast_nothing(spark):
    rows = spark.createDataFrame([("l", "a", "ACGTTGCAAC", True), ("l", "b", "GTTGCAACGG", False)], "locus string, read string, seq string, target boolean")
    plan = evidence.read_overlaps(rows, 4, 2, 4, 2)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan.split("== Physical Plan ==")[1]


def test_edit_similarity_links_copies_to_one_part(spark, tmp_path):
    rows = [(k, ["ab cd", "ab ce"][k % 2], "B", "T", 1) for k in range(400)] + [(900, "zz", "B", "T", 2)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.a, r.b): r.edits for r in domain.edit_similarity(spark, str(tmp_path)).collect()}
    assert got == {(0, 1): 1, **{(k % 2, k): 0 for k in range(2, 400)}}
