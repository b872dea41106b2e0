"""Inversions, homopolymers and insertions on hand-made rows."""

import random

from pyspark.sql import functions as F

from spanloom.plans import homopolymers, insertions, inversions
from spanloom.sources import vcf


def test_breakends_pair_to_inversions(spark):
    rows = [("r1", "c", 100, 500, False), ("l1", "c", 104, 498, True), ("l2", "c", 130, 520, True), ("r2", "c", 9000, 9500, False)]
    df = spark.createDataFrame(rows, "id string, chr string, start long, end long, left_facing boolean")
    got = inversions.pair_breakends(df, 50).collect()
    assert [(r.id, r.start, r.end, r.inv_start, r.inv_end) for r in got] == [("r1+l1", 100, 500, 104, 498)]


def test_replacement_by_its_reverse_complement_is_an_inversion(spark):
    r = random.Random(1)
    ref = "".join(r.choice("ACGT") for _ in range(400))
    rc = ref[101:201].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    other = "".join(r.choice("ACGT") for _ in range(100))
    rows = [("inv", "c", 100, 200, "DEL", rc, False), ("no", "c", 100, 200, "DEL", other, False), ("imp", "c", 100, 200, "DEL", rc, True), ("small", "c", 100, 120, "DEL", "", False)]
    v = spark.createDataFrame(rows, "id string, chr string, start long, end long, svtype string, ins_seq string, imprecise boolean")
    got = {x.id: (x.svtype, x.ins_seq) for x in inversions.relabelled(v, spark.createDataFrame([("c", ref)], "chr string, seq string")).collect()}
    assert got == {"inv": ("INV", ""), "no": ("DEL", other), "imp": ("DEL", rc), "small": ("DEL", "")}


def test_inversion_filters(spark):
    names = ["flank_depth", "anchor_depth", "alt_reads", "ref_reads", "alt_pairs", "ref_pairs", "pos_mq", "neg_mq", "anchor_length", "alt_score", "ref_score"]
    good = dict(zip(names, (30, 30, 8, 2, 9, 1, 60, 60, 400, 90, 50)))
    cases = {"good": {}, "pairs_fail": {"pos_mq": 5}, "both_fail": {"flank_depth": 500}, "reads_only": {"alt_pairs": 0}, "none": {"pos_mq": 5, "alt_score": 10}}
    rows = [(k, *[(good | c)[n] for n in names], *[None] * len(names)) for k, c in cases.items()]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{n}_{s} int" for s in "12" for n in names))
    got = {r.id: (r.filters, r.gt) for r in inversions.judged(df, 5, 100, 500, 4).collect()}
    assert got["good"] == (["PASS"], [1, 1]) and got["pairs_fail"] == (["PASS"], [1, 1]) and got["reads_only"][0] == ["PASS"]
    assert got["both_fail"] == (["ANOMALOUS_FLANKING_DEPTH"], [0, 0]) and got["none"] == (["LOW_MAPQ_DISC_PAIRS", "LOW_ALT_CONSENSUS_SCORE"], [0, 0])


def test_runs_do_not_depend_on_pieces(spark):
    r = random.Random(2)
    ref = "".join(r.choice("AC") for _ in range(3000))
    df = spark.createDataFrame([("c", ref), ("e", "")], "contig string, seq string")
    one = sorted(map(tuple, homopolymers.reference_runs(df, 5).collect()))
    many = sorted(map(tuple, homopolymers.reference_runs(df, 5, piece=200).collect()))
    assert one == many and all(ref[s:e] == b * (e - s) and e - s >= 5 and ref[max(0, s - 5) : s] == left and ref[e : e + 5] == right for _, s, e, b, left, right in one) and len(one) > 20


def test_stutter_and_alleles(spark):
    rows = [("A", 10, 10)] * 8 + [("A", 10, 9)] + [("A", 10, 3)]
    got = {r.delta: r.rate for r in homopolymers.stutter_profile(spark.createDataFrame(rows, "base string, length int, shown int")).collect()}
    assert got == {0: 0.8, -1: 0.1, -3: 0.1}
    seen = spark.createDataFrame([("x", n) for n in [10] * 6 + [12] * 5 + [11, 9, 14]], "id string, length int")
    assert {(r.allele, r.reads) for r in homopolymers.alleles(seen).collect()} == {(10, 8), (12, 6)}
    profile = {n: {-1: 0.1, 1: 0.05} for n in range(5, 20)}
    r = homopolymers.genotyped(seen, profile).first()
    assert (r["first"], r.second) == (10, 12) and r.lead > 0
    s = homopolymers.summaries(seen).first()
    assert (s["mode"], s.n_reads) == (10, 14)


def test_recalibration_pools(spark):
    e = spark.createDataFrame([("A", 10, 1, 30, 1000, 100), ("A", 10, 2, 30, 10, 9), ("A", 10, 2, 20, 200, 2)], "base string, length int, position int, quality int, observations long, errors long").withColumn("error", F.col("errors") / F.col("observations"))
    b = spark.createDataFrame([("A", 10, 1, 30), ("A", 10, 2, 30), ("A", 10, 9, 30), ("C", 10, 1, 30), ("A", 10, 1, None)], "base string, length int, position int, quality int")
    got = {(r.base, r.position, r.quality): r.new_quality for r in homopolymers.recalibrated(b, e).collect()}
    # 10 % errors are quality 10; 11 of 210 are 13; 111 of 1210 are 10; an unknown base keeps its quality.
    assert got == {("A", 1, 30): 10, ("A", 2, 30): 13, ("A", 9, 30): 10, ("C", 1, 30): 30, ("A", 1, None): None}


def test_insertion_from_reads(spark):
    r = random.Random(3)
    seq = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    left, right, ins = seq(120), seq(120), seq(90)
    whole = left + ins + right
    reads = [(1, whole[k : k + 60]) for k in range(60, 210, 6)] + [(2, seq(60)) for _ in range(12)]
    df = spark.createDataFrame(reads, "locus long, seq string")
    flanks = spark.createDataFrame([(1, left, right), (2, left, right)], "locus long, left string, right string")
    got = {x.locus: x for x in insertions.assembled_insertions(df, flanks, 25, 100).collect()}
    assert got[1].ins_seq == ins and got[2].ins_seq is None
    assert insertions.supported(ins, [s for k, s in reads if k == 1], left, right) and not insertions.supported(ins, [s for k, s in reads if k == 2], left, right)
    deep = {x.locus: x.too_deep for x in insertions.assembled_insertions(df, flanks, 25, 20).collect()}
    assert deep == {1: True, 2: False}
    assert insertions.detect([left + ins[:40], ins[50:] + right], left, right) == ins[:40] + "-" + ins[50:]


def test_clusters_of_stable_reads(spark):
    rows = [("c", f"f{k}", 1000 + 5 * k, 1100 + 5 * k) for k in range(5)]
    f = insertions.stable_clusters(spark.createDataFrame(rows, "contig string, qname string, lo long, hi long"), 200, 100, 3)
    b = insertions.stable_clusters(spark.createDataFrame([("c", q, a + 150, e + 150) for _, q, a, e in rows], "contig string, qname string, lo long, hi long"), 200, 100, 3)
    got = insertions.facing_pairs(f, b, 400).collect()
    assert [(x.f_hi, x.r_lo, x.score) for x in got] == [(1120, 1150, 10)]
    mates = spark.createDataFrame([(1, "d", p) for p in (10, 20, 30, 900)] + [(1, "e", 5)], "cluster long, contig string, pos long")
    assert {(x.contig, x.start, x.score) for x in insertions.source_windows(mates, 100).collect()} == {("d", -70, 3), ("e", -95, 1)}


def test_header_families():
    tags = vcf.support_tags()
    assert len(tags) == 25 * 4 + 9 * 6 + 8 * 2 and len({t[0] for t in tags}) == len(tags)
    lines = vcf.header([("c", 5)], ["s"])
    assert lines[0].startswith("##fileformat") and lines[-1].endswith("FORMAT\ts") and "##contig=<ID=c,length=5>" in lines
