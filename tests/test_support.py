"""Guided assembly, targets, reuse and homopolymer stages on constructed sequences."""

import random

from pyspark.sql import functions as F

from spanloom.plans import assembly, support
from spanloom.sources import readers

R = random.Random(12)


def dna(n):
    return "".join(R.choice("ACGT") for _ in range(n))


def pieces(s, size=60, step=15):
    return [s[k : k + size] for k in range(0, len(s) - size + 1, step)]


def test_guided_assembly_orders_and_bridges():
    ref = dna(500)
    contigs, unused = assembly.guided(pieces(ref), ref, 20)
    assert [c for c, *_ in contigs] == [ref[: len(contigs[0][0])]] and not unused
    novel = dna(120)
    sample = ref[:240] + novel + ref[260:]
    contigs, unused = assembly.guided(pieces(sample, 60, 6), ref, 30)
    told = assembly.bridged(contigs, unused, 25)
    assert any(sample[40:-80] in c or sample[100:400] in c for c in told) or len(told) >= 2
    joined = assembly.bridged([(ref[:100], 0, 100), (ref[160:300], 160, 300)], pieces(ref[60:200], 60, 10), 20)
    assert joined == [ref[:300]]


def test_templates_and_run_lengths():
    l, i, r = dna(50), dna(40), dna(50)
    assert assembly.template(l, l[-12:] + i + r[:15], r) == l + i + r and assembly.template(l, i, r) == l + i + r
    contig = dna(20) + "C" + "A" * 12 + "G" + dna(20)
    long = contig.replace("A" * 12, "A" * 14)
    reads = [long[5:50]] * 3 + [contig[5:50]]
    assert assembly.run_lengths(contig, reads) == long and assembly.run_lengths(contig, [contig[5:50], long[5:50]]) == contig


def test_guided_insertion():
    l, ins, r = dna(100), dna(80), dna(100)
    reads = pieces(l + ins + r, 50, 5)
    assert assembly.guided_insertion(l, r, ins[:60], reads) == ins or assembly.guided_insertion(l, r, ins, reads) == ins
    assert assembly.guided_insertion(l, r, ins, [dna(50)]) is None


def test_best_consensus():
    s = dna(100)
    wrong = s[:50] + ("A" if s[50] != "A" else "C") + s[51:]
    reads = [(s[k : k + 60], [30] * 60) for k in (0, 5, 20, 35, 40)]
    seq, score = assembly.best_consensus([wrong, s], reads)
    assert seq == s[5:95] and score > 0 and assembly.best_consensus([s], reads[:1]) is None


def test_extension_in_blocks(spark):
    s = dna(400)
    c = spark.createDataFrame([("a", s[:80]), ("b", dna(80))], "id string, seq string")
    r = spark.createDataFrame([("a", x) for x in pieces(s, 60, 20)], "id string, seq string")
    got = {x.id: (x.extended, x.added) for x in support.extended_consensuses(c, r, 30, 100, 250).collect()}
    assert got["a"] == (s[:330], 250) and got["b"][1] == 0
    assert {x.added for x in support.extended_consensuses(c, r, 30, 100, 250, max_reads=3).collect()} == {0}


def test_duplications_of_many_copies(spark):
    ref = dna(600)
    v = spark.createDataFrame([("small", "c", 299, 329, "DUP", ""), ("large", "c", 99, 399, "DUP", "")], "id string, chr string, start long, end long, svtype string, ins_seq string")
    contigs = spark.createDataFrame([("c", ref)], "chr string, seq string")
    t = {(r.id, r.copies): r for r in support.duplication_targets(v, contigs, 100).collect()}
    unit = ref[300:330]
    assert {k for k in t} == {("small", 1), ("small", 2), ("small", 3), ("small", 4), ("large", 1)}
    assert t["small", 2].alt_seq == ref[200:300] + unit * 3 + ref[330:430] and t["large", 1].alt_seq == ref[300:400] + ref[100:200] and t["large", 1].large
    three = ref[280:300] + unit * 2 + ref[330:350]
    read = lambda name, pos, seq: (name, 1 | 64, "c", pos, 60, [("M", len(seq))], "c", 0, 0, seq, [35] * len(seq), 0, 60, "100M", "")
    reads = spark.createDataFrame([read("two", 280, three), read("ref", 280, ref[280:380]), read("far", 500, ref[500:600])], readers.READS)
    got = {(r.sv_id, r.read): (r.kind, r.copies) for r in support.duplication_evidence(reads, v.where("id = 'small'"), contigs, 100).collect()}
    assert got == {("small", "two_1"): ("alt", 1), ("small", "ref_1"): ("ref", 0)}
    every, deep = support.all_evidence(reads, v, contigs, 100, 50)
    assert every.where("kind = 'alt'").count() >= 1 and deep.count() == 0


def test_work_is_reused(spark, tmp_path):
    calls = []

    def build(df):
        calls.append(df.count())
        return df.withColumn("n", F.length("text"))

    a = spark.createDataFrame([(1, "xx"), (2, "xx"), (3, "y")], "id int, text string")
    b = a.union(spark.createDataFrame([(4, "new")], a.schema))
    at = f"{tmp_path}/cache"
    assert {(r.id, r.n) for r in support.reused(a, at, build, ["text"]).collect()} == {(1, 2), (2, 2), (3, 1)}
    assert {(r.id, r.n) for r in support.reused(b, at, build, ["text"]).collect()} == {(1, 2), (2, 2), (3, 1), (4, 3)} and calls == [2, 1]
    rows = spark.createDataFrame([("c", "alt", "v"), ("c", "ref", "v"), ("c", "alt", "w")], "contig string, kind string, sv_id string")
    rows.write.partitionBy("kind").parquet(f"{tmp_path}/ev")
    assert support.kept_evidence(spark, f"{tmp_path}/ev", spark.createDataFrame([("v",)], "id string"), ("alt",)).count() == 1


def test_mates_over_runs(spark):
    ref = dna(300) + "A" * 12 + dna(300)
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    mate = ref[270:350]
    a = spark.createDataFrame([("f", "c", 100, False, rc(mate)), ("clip", "c", 100, False, rc(mate[:-10] + dna(10))), ("far", "c", 5000, False, rc(mate)), ("r", "c", 500, True, mate)], "qname string, contig string, pos long, reverse boolean, mate_seq string")
    runs = spark.createDataFrame([("u", "c", 300, 312)], "id string, contig string, start long, end long")
    got = {r.qname: r.seq for r in support.rescued_mates(a, runs, spark.createDataFrame([("c", ref)], "contig string, seq string"), 100, 400).collect()}
    assert got == {"f": mate, "r": mate}


def test_consensus_over_a_run():
    l, r = "GATTACAGATCC", "GGCATTGCAT"
    s = l + "A" * 8 + r
    reads = [(s, [30] * len(s), 12, 20, k % 2 == 0) for k in range(6)]
    assert support.run_consensus(reads) == (s, 12, 20)
    bad = (l[:-1] + "G" + "A" * 8 + r, [30] * len(s), 12, 20, False)
    assert support.run_consensus(reads + [bad] * 5)[0] == s  # the left flank is told by reads that begin there
