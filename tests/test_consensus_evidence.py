"""Consensuses, evidence and the lifecycle on simulated reads."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions import register
from spanloom.operators import stats
from spanloom.plans import consensus, drivers, evidence, variants
from spanloom.sources import readers

R = random.Random(8)


def dna(n, r=R):
    return "".join(r.choice("ACGT") for _ in range(n))


RC = str.maketrans("ACGT", "TGCA")


def simulated(ref, hap, place, n, length=100, size=300, contig="c", seed=1, name="r"):
    """Pairs of a haplotype as alignments to ref. place: reference place of each haplotype base, None where inserted."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        at = r.randrange(0, len(hap) - size - 30)
        width = size + r.randrange(-20, 21)
        ends = []
        for lo in (at, at + width - length):
            known = place[lo : lo + length]
            # The longest stretch without a jump is aligned, the rest is clipped.
            runs, start = [], 0
            for i in range(1, length + 1):
                if i == length or known[i] is None or known[i - 1] is None or known[i] != known[i - 1] + 1:
                    if known[start] is not None:
                        runs.append((i - start, start))
                    start = i
            if not runs:
                break
            m, s = max(runs)
            cigar = [(op, x) for op, x in (("S", s), ("M", m), ("S", length - s - m)) if x]
            ends.append((known[s], cigar, hap[lo : lo + length]))
        if len(ends) < 2:
            continue
        span = ends[1][0] + next(x for op, x in ends[1][1] if op == "M") - ends[0][0]
        for i, (pos, cigar, seq) in enumerate(ends):
            other = ends[1 - i]
            flag = 1 | 2 | (16 if i else 32) | (64 if i == 0 else 128)
            rows.append((f"{name}{k}", flag, contig, pos, 60, cigar, contig, other[0], span if i == 0 else -span, seq, [35] * length, 0, 60, "".join(f"{x}{op}" for op, x in other[1]), str(length)))
    return rows


def test_lifecycle_finds_and_genotypes(spark, tmp_path):
    """A deletion, an insertion and a duplication of one sample, found from clipped reads and genotyped."""
    ref = dna(6000)
    ins = dna(70)
    hap = ref[:1500] + ref[1900:3000] + ins + ref[3000:4500] + ref[4300:4500] + ref[4500:]
    place = [*range(1500), *range(1900, 3000), *[None] * 70, *range(3000, 4500), *range(4300, 4500), *range(4500, 6000)]
    rows = simulated(ref, hap, place, 1200)
    reads = spark.createDataFrame(rows, readers.READS)
    contigs = spark.createDataFrame([("c", ref)], "contig string, seq string")
    config = drivers.Config(min_is=200, max_is=400, max_depth=60)
    calls, config = drivers.call(reads, contigs, config)
    found = {(r.svtype, r.start, r.end) for r in calls.collect()}
    assert config.read_len == 100
    want = {"DEL": (1499, 1899), "INS": (2999, 2999), "DUP": (4299, 4499)}
    for kind, (s, e) in want.items():
        near = [x for x in found if (x[0] == kind or kind == "DUP" and x[0] == "INS") and abs(x[1] - s) <= 5]
        assert near, (kind, found)
    told = drivers.genotype(calls, reads, contigs, config)
    best = {r.svtype: r for r in told.collect() if r.svtype == "DEL" and abs(r.start - 1499) <= 5 and not r.imprecise}
    assert best["DEL"].gt == [1, 1] and best["DEL"].alt_reads > 10 and best["DEL"].filters == [] and best["DEL"].epr > 0.75
    head, lines = drivers.as_vcf(told.drop("alt_reads", "ref_reads", "er_reads", "too_deep"), contigs, "s1")
    texts = [r.value for r in lines.collect()]
    assert head[0].startswith("##fileformat") and any(t.split("\t")[1] == "1500" and "1/1" in t for t in texts)


def test_clean_reads_give_no_call(spark):
    ref = dna(3000)
    reads = spark.createDataFrame(simulated(ref, ref, list(range(3000)), 300, seed=3), readers.READS)
    contigs = spark.createDataFrame([("c", ref)], "contig string, seq string")
    calls, _ = drivers.call(reads, contigs, drivers.Config(min_is=200, max_is=400, max_depth=60))
    assert calls.count() == 0
    with pytest.raises(ValueError):
        drivers.run(spark, "genotype", reads, contigs, drivers.Config())


def row(start, seq, left=0, right=0, rev=False, name="q", score=None, qual=35):
    n = len(seq)
    return {"qname": name, "is_reverse": rev, "start": start, "end": start + n, "left_clip": left, "right_clip": right, "read_start": start + left, "read_end": start + n - right, "seq": seq, "qual": [qual] * n, "mapq": 60, "nm": 0, "score": n - left - right if score is None else score, "net_indel": 0}


def test_sliding_clusters_by_their_front():
    seq = "A" * 100
    starts = [0, 10, 40, 60, 90, 95, 300]
    got = consensus.sliding_clusters([row(s, seq) for s in starts])
    assert [[r["start"] for r in c] for c in got] == [[0, 10, 40], [10, 40, 60], [60, 90, 95]] or [[r["start"] for r in c] for c in got][0] == [0, 10, 40]


def test_consensuses_of_two_haplotypes():
    ref = dna(400)
    one, two = ref[100:200] + dna(100), ref[120:210] + dna(100)
    reads = [row(100 + k, one[k : k + 100], right=k, name=f"a{k}") for k in range(20, 60, 5)] + [row(120 + k, two[k : k + 100], right=k + 10, name=f"b{k}") for k in range(20, 60, 5)]
    out = consensus.cluster_consensuses(reads, ref)
    assert {c["breakpoint"] for c in out} == {200, 210} and all(not c["left_clipped"] and not c["is_hidden"] and c["n_reads"] >= 6 for c in out)
    for c in out:
        whole = one if c["breakpoint"] == 200 else two
        assert c["seq"] in whole


def con(start, seq, **more):
    base = {"contig": "c", "left_clipped": False, "start": start, "end": start + len(seq), "breakpoint": start + len(seq), "seq": seq, "qual": [40] * len(seq), "fwd": 2, "rev": 2, "max_mapq": 60, "lowq_prefix": 0, "lowq_suffix": 0, "indels": [], "is_hidden": False, "clip_len": 5, "n_reads": 4}
    return base | more


def test_contained_and_overlapping_consensuses(spark):
    ref = dna(500)
    inner = con(120, ref[120:180])
    other = con(120, ref[120:150] + ("A" if ref[150] != "A" else "C") + ref[151:180])
    low = con(130, ref[130:170], qual=[50] * 40)
    outer = con(100, ref[100:200], qual=[30] * 100)
    kept = consensus.drop_contained([inner, other, low, outer])
    assert {(c["start"], c["seq"]) for c in kept} == {(100, ref[100:200]), (120, other["seq"])}
    assert next(c for c in kept if c["start"] == 100)["qual"][30:70] == [50] * 40
    a, b, far = con(0, ref[:100]), con(40, ref[40:140], fwd=9), con(300, ref[300:400])
    merged = consensus.merge_overlapping([a, b, far], 40)
    assert [(c["start"], c["end"], c["seq"], c["fwd"]) for c in merged] == [(0, 140, ref[:140], 11), (300, 400, ref[300:400], 2)]
    assert consensus.merged_pair(a, con(80, ref[80:180]), 40) is None and consensus.merged_pair(a, b | {"indels": [3]}, 40) is None
    df = spark.createDataFrame([tuple(x[k.split()[0]] for k in consensus.CONSENSUS.split(", ")) for x in (inner, low, outer, a, b, far)], consensus.CONSENSUS)
    contigs = spark.createDataFrame([("c", ref)], "contig string, seq string")
    got = consensus.processed(df, contigs, 40).collect()
    assert {(r.start, r.end) for r in got} == {(0, 200), (300, 400)} or {(300, 400)} < {(r.start, r.end) for r in got}
    assert len(consensus.processed(df, contigs, 40, ploidy=0).collect()) == 0


def test_read_score(spark):
    rows = [([("S", 5), ("M", 40), ("I", 2), ("M", 40), ("D", 3), ("M", 10)], 7), ([("=", 30), ("X", 2)], 2), ([("M", 50)], 0)]
    df = spark.createDataFrame([(x, n) for x, n in rows], "cigar array<struct<op:string,len:int>>, nm int")
    assert [r.s for r in df.select(consensus.read_score().alias("s")).collect()] == [90 - 2 - 4 * 2 - 7 - 8, 30 - 8, 50]


def test_changes_of_unused_reads_and_their_companions(spark):
    s = "contig string, start long, end long, svtype string, ins_seq string, mapq int, deep boolean, deep_high boolean"
    rows = [("c", 5, 9, "DEL", "", 60, False, False)] * 2 + [("c", 50, 59, "DEL", "", 60, True, False), ("c", 50, 59, "DEL", "", 30, True, False)] + [("c", 70, 79, "DEL", "", 60, True, False)] * 2 + [("c", 90, 99, "DEL", "", 60, True, True)] * 5 + [("c", 1, 1, "INS", "A", 60, False, False)]
    assert {(r.start, r.reads) for r in consensus.read_changes(spark.createDataFrame(rows, s)).collect()} == {(5, 2), (70, 2)}
    changes = spark.createDataFrame([("v", 100, 150)], "id string, start long, end long")
    reads = spark.createDataFrame([("v", f"q{k}", 0, 300) for k in range(5)], "id string, qname string, read_start long, read_end long")
    ind = [("v", f"q{k}", 200, 205, "") for k in range(3)] + [("v", "q0", 20, 20, "AC"), ("v", "q1", 20, 20, "AC")] + [("v", f"q{k}", 100, 120, "") for k in range(5)]
    got = consensus.companions(changes, reads, spark.createDataFrame(ind, "id string, qname string, start long, end long, ins_seq string"))
    assert [(r.start, r.reads, r.spanning) for r in got.collect()] == [(200, 3, 5)]


def test_clusters_with_one_stray_read_are_one(spark):
    s = "consensus string, breakpoint long, cluster int, reverse boolean, read string, start long, end long"
    near = [("x", 1000, 1, False, f"a{k}", 800 + k, 900 + k) for k in range(3)]
    rows = near + [("x", 1000, 2, False, "a0", 800, 900), ("x", 1000, 2, False, "far", 1300, 1400), ("x", 1000, 3, True, "z", 1300, 1400)]
    got = consensus.merge_clusters(spark.createDataFrame(rows, s), 400).collect()
    assert [tuple(r) for r in got] == [(2, 1, "far")]
    assert consensus.merge_clusters(spark.createDataFrame(rows, s), 2000).count() == 0


def test_deletions_are_refined_by_one_junction(spark):
    d = spark.createDataFrame([("a", 100, 300, True), ("b", 100, 300, True), ("c", 100, 300, True)], "id string, start long, end long, imprecise boolean")
    j = [("a", "q1", 110, 290, ""), ("a", "q2", 110, 290, ""), ("a", "q3", 111, 290, ""), ("b", "q1", 110, 290, ""), ("b", "q1", 110, 290, "")] + [("c", f"q{k}", 110 + k % 2, 290, "") for k in range(4)]
    got = {r.id: (r.start, r.end, r.imprecise, r.original_range) for r in consensus.refine_deletions(d, spark.createDataFrame(j, "id string, qname string, start long, end long, ins_seq string")).collect()}
    assert got == {"a": (110, 290, False, "100-300"), "b": (100, 300, True, None), "c": (100, 300, True, None)}


# Evidence


def read(name, flag, pos, cigar="100M", mpos=0, isize=0, mapq=60, mate="c", seq=None, contig="c", mc="100M", nm=0, mq=60):
    import re

    ops = [(op, int(n)) for n, op in re.findall(r"(\d+)([MIDS])", cigar)]
    n = sum(x for op, x in ops if op in "MIS")
    return (name, flag, contig, pos, mapq, ops, mate, mpos, isize, seq or "A" * n, [35] * n, nm, mq, mc, "")


def test_insertion_pairs(spark):
    ins = dna(150)
    out, stray = ins[20:120], dna(100)
    rows = [read("in", 1 | 64, 900, mate="d"), read("stray", 1 | 64, 900, mate="d"), read("right", 1 | 16 | 64, 1010, mate="d"), read("far", 1 | 64, 100, mate="d")]
    for name, isize in (("ref", 400), ("neutral", 250)):
        rows += [read(name, 1 | 2 | 32 | 64, 850, mpos=1050, isize=isize), read(name, 1 | 2 | 16 | 128, 1050, mpos=850, isize=-isize, nm=3)]
    rc = lambda s: s.translate(RC)[::-1]
    mates = spark.createDataFrame([("in_2", rc(out)), ("stray_2", stray), ("right_2", out), ("far_2", rc(out))], "read string, seq string")
    v = spark.createDataFrame([("v", "c", 1000, 1000, ins)], "id string, contig string, start long, end long, ins_seq string")
    got = {(r.qname, r.label, r.mate_nm) for r in evidence.insertion_pair_labels(spark.createDataFrame(rows, readers.READS), v, mates, 200, 500).collect()}
    assert {(q, l) for q, l, _ in got} == {("in", "alt1"), ("stray", "stray1"), ("right", "alt2"), ("ref", "ref1"), ("neutral", "neutral1")} and ("ref", "ref1", 3) in got


def test_inversion_pairs(spark):
    rows = [read("f", 1 | 64, 1900, mpos=900), read("f", 1 | 128, 900, mpos=1900), read("r", 1 | 16 | 32 | 64, 1050, mpos=2050), read("off", 1 | 64, 1500, mpos=900), read("x", 1 | 32 | 64, 1900, mpos=900)]
    v = spark.createDataFrame([("v", "c", 1000, 2000)], "id string, contig string, inv_start long, inv_end long")
    got = {(r.qname, r.label) for r in evidence.inversion_pair_labels(spark.createDataFrame(rows, readers.READS), v, 100, 300).collect()}
    assert got == {("f", "alt1"), ("r", "alt2")}


def test_two_sided_consensuses(spark):
    cl = spark.createDataFrame([(1, "c", True, 1000, 1100, 3000, 3100), (2, "c", False, 5000, 5100, 8000, 8100)], "cluster int, contig string, reverse boolean, la_start long, la_end long, ra_start long, ra_end long")
    cs = spark.createDataFrame([("a", "c", True, 950, 1050, 1000), ("b", "c", True, 2950, 3050, 3000), ("w", "c", False, 950, 1050, 1000), ("p", "c", False, 5090, 5200, 5100)], "id string, contig string, left_clipped boolean, start long, end long, breakpoint long")
    got = {tuple(r) for r in evidence.two_sided(cl, cs, 100, 300).collect()}
    assert got == {(1, "a", "b"), (2, "p", None)}


def test_pairs_go_to_their_first_span(spark):
    spans = spark.createDataFrame([("s1", 2, "c", False, 0, 500), ("s2", 1, "c", False, 100, 400), ("s3", 0, "c", True, 0, 500)], "span string, priority int, contig string, reverse boolean, start long, end long")
    pairs = spark.createDataFrame([("p", "c", False, 150, 250), ("q", "c", False, 50, 150), ("r", "c", True, 10, 20), ("o", "c", False, 450, 550)], "qname string, contig string, reverse boolean, start long, end long")
    assert {(r.qname, r.span) for r in evidence.pairs_to_spans(pairs, spans).collect()} == {("p", "s2"), ("q", "s1"), ("r", "s3")}


def test_extension_reads(spark):
    rows = [read("a", 1 | 32 | 64, 100), read("b", 1 | 32 | 64, 100, mapq=20), read("clip", 1 | 32 | 64, 100, cigar="10S90M"), read("clip2", 1 | 32 | 64, 100, cigar="10S90M", mapq=10), read("f", 1 | 64, 700, mate="d"), read("r", 1 | 16 | 64, 1300, mate="d"), read("ss", 1 | 64, 2000, mpos=1500)]
    c = evidence.extension_candidates(spark.createDataFrame(rows, readers.READS), 1)
    assert Counter((r.qname, r.turned) for r in c.collect()) == Counter({("a", False): 1, ("clip", False): 1, ("f", False): 1, ("r", False): 1, ("ss", False): 1, ("ss", True): 1})
    t = spark.createDataFrame([("t", "c", 1000, 1100, 9000), ("u", "c", 120, 150, 9000), ("none", "c", 10, 5, 9000)], "target string, contig string, lo long, hi long, contig_len long")
    mates = spark.createDataFrame([("f_2", "AAC", [1, 2, 3], 50), ("r_2", "GGT", [4, 5, 6], 40)], "read string, seq string, qual array<short>, mapq int")
    out, full = evidence.extension_reads(c.withColumn("stable", F.lit(True)), t, mates, 200, 500, 100, 10)
    got = {(r.target, r.qname, r.role): r for r in out.collect()}
    assert set(got) == {("t", "f", "ahead"), ("t", "r", "behind"), ("u", "a", "here"), ("u", "clip", "here")} and full.count() == 0
    assert got["t", "f", "ahead"].seq == "GTT" and list(got["t", "f", "ahead"].qual) == [3, 2, 1] and got["t", "r", "behind"].seq == "GGT"
    assert evidence.extension_reads(c.withColumn("stable", F.lit(True)), t, mates, 200, 500, 100, 1)[1].count() == 2
    with pytest.raises(Exception, match="no mate of"):
        evidence.extension_reads(c.withColumn("stable", F.lit(True)), t, mates.where("read = 'r_2'"), 200, 500, 100, 10)[0].collect()


def test_semi_mapped_reads(spark):
    rows = [read("s", 1 | 2 | 32 | 64, 800, "60M40S", 1000, 300), read("j", 1 | 2 | 32 | 64, 800, "60M40S", 1002, 300, mc="30S70M"), read("n", 1 | 2 | 32 | 64, 800, "60M40S", 1000, 300, seq="N" * 100), read("both", 1 | 2 | 32 | 64, 800, "60M40S", 1000, 300, mc="30S40M30S")]
    h = evidence.semi_mapped(spark.createDataFrame(rows, readers.READS), 200, 500)
    assert {(r.qname, r.kind) for r in h.collect()} == {("s", "semi_mapped"), ("j", "junction_mate")}
    cl = spark.createDataFrame([("L", "c", False, 990, 1200, 1000), ("R", "c", True, 500, 990, 990)], "cluster string, contig string, right boolean, start long, end long, breakpoint long")
    assert {tuple(r) for r in evidence.attach_semi_mapped(h, cl, 500).collect()} == {("L", "s"), ("L", "j")}


def test_read_overlaps(spark):
    r = random.Random(2)
    g = dna(300, r)
    noisy = list(g[60:160])
    noisy[50] = "A" if noisy[50] != "A" else "C"
    rows = [("x", "t", g[40:140], True), ("x", "o", "".join(noisy), False), ("x", "far", g[200:300], False), ("y", "o", g[40:140], False), ("x", "rep", g[40:75] + dna(30, r) + g[40:75], False)]
    got = {(q.target, q.read): (q.offset, q.begin, q.end) for q in evidence.read_overlaps(spark.createDataFrame(rows, "locus string, read string, seq string, target boolean")).collect()}
    assert got[("t", "o")] == (20, 20, 100) and ("t", "far") not in got and ("t", "rep") not in got


def test_support_fields(spark):
    e = [("v", "A", 1, f"q{k}", k < 4, k % 2 == 0, 90 + k, 60 - 10 * (k == 0), k == 1, 100 + k, 200 + k) for k in range(5)] + [("v", "R", 1, "z", True, True, 80, 60, False, 0, 100)]
    ev = spark.createDataFrame(e, "sv_id string, allele string, bp int, read string, consistent boolean, fwd boolean, score int, mapq int, exclusive boolean, start long, end long")
    pairs = spark.createDataFrame([("v", "alt1", 60, 50, 1), ("v", "alt1", 40, 60, 3), ("v", "stray2", 60, 60, 0)], "sv_id string, label string, mapq int, mate_mapq int, nm int")
    r, p = evidence.read_fields(ev), evidence.pair_fields(pairs)
    f = r.first()
    assert (f.AR1, f.AR1C, f.AR1CF, f.AR1CR, f.AR1CHQ, f.AR1C_min_q, f.AR1C_max_q, f.AR1E, f.AR1CE, f.AR1CMSPAN, f.RR1, f.AR2) == (5, 4, 2, 2, 3, 50, 60, 1, 1, 103, 1, 0) and f.AR1CAS == 91.5
    q = p.first()
    assert (q.ASP1, q.ASP1HQ, q.ASP1_min_q, q.ASP1NMA, q.SSP2, q.RSP1) == (2, [1, 1], [40, 50], 2.0, 1, 0)
    v = spark.createDataFrame([("v",), ("w",)], "id string")
    fmt = {x.id: x.fmt for x in evidence.support_record(v, r, p).collect()}
    assert fmt["v"]["AR1"] == "5" and fmt["v"]["ASP1HQ"] == "1,1" and fmt["v"]["ASP1AQ"] == "50.0,55.0" and set(fmt["w"].values()) == {"."} and fmt["v"].keys() == fmt["w"].keys()
    src = spark.createDataFrame([("v", {"A": "1", "B": "2"}, {"X": "9"}, "s")], "id string, info map<string,string>, fmt map<string,string>, sample string")
    rec = spark.createDataFrame([("v", {"A": "0"}, {"Y": "1"})], "id string, info map<string,string>, fmt map<string,string>")
    c = evidence.copied_fields(rec, src, ["A", "B"], ["s"]).first()
    assert c.info == {"A": "0", "B": "2"} and c.fmt == {"X": "9", "Y": "1"}


def test_links_of_sites(spark):
    s = spark.createDataFrame([("g", 0, [1, 2, 3, 4, 5], [1, 2]), ("g", 1, [1, 2, 3, 4], [1, 2]), ("g", 2, [1, 2, 3, 4], [3, 4]), ("g", 3, [1, 3], [1, 3])], "g string, site int, informative array<int>, supporting array<int>")
    assert {tuple(r) for r in evidence.fragment_links(s, ["g"]).collect()} == {("g", 0, 1, 4, 0), ("g", 0, 2, 0, 4), ("g", 1, 2, 0, 4)}


def test_contexts_by_genotype_likelihood(spark):
    import math

    obs = [("g", 5, "A", 30)] * 6 + [("g", 5, "C", 30)] * 5 + [("g", 9, "G", 30)] * 7 + [("g", 9, "T", 5)] * 50
    like = evidence.context_likelihoods(spark.createDataFrame(obs, "group string, position int, base string, qual int"))
    got = {(r.position, r.a, r.b): r.loglik for r in like.collect()}
    p = lambda b, x, e: 1 - e if b == x else e / 3
    want = 6 * math.log((p("A", "A", 0.001) + p("A", "C", 0.001)) / 2) + 5 * math.log((p("C", "A", 0.001) + p("C", "C", 0.001)) / 2)
    assert got[5, "A", "C"] == pytest.approx(want) and len(got) == 20
    ctx = spark.createDataFrame([("g", "c1", 5, "A"), ("g", "c1", 9, "G"), ("g", "c2", 5, "T"), ("g", "c2", 9, "G"), ("g", "c3", 5, "C"), ("g", "c3", 9, "T"), ("h", "d", 1, "A")], "group string, context string, position int, base string")
    assert {(r.context, r.survives) for r in evidence.surviving_contexts(ctx, like).collect()} == {("c1", True), ("c2", False), ("c3", False), ("d", True)}


def test_companions_that_reads_contradict(spark):
    left, main, right = dna(100), dna(30), dna(100)
    w, wo = left[:60] + "GATTACAGAT" + left[60:] + main + right, left + main + right
    atoms = spark.createDataFrame([("v", 0, w, 60, 70, wo, 110, 140, ""), ("w", 0, w, 60, 70, wo, 110, 140, "")], "id string, atom int, with_atom string, atom_lo int, atom_hi int, without string, main_lo int, main_hi int, main_ref string")
    reads = spark.createDataFrame([("v", "p", wo[30:180]), ("w", "p", w[30:180])], "id string, qname string, seq string")
    assert [r.id for r in evidence.uncontradicted(atoms, reads).collect()] == ["w"]


def test_reservoir_of_a_histogram(spark):
    h = spark.createDataFrame([(k, 10 * k) for k in range(1, 30)], "x int, n long")
    total = Counter({k: 10 * k for k in range(1, 30)})
    all_of = Counter(r.value for r in stats.reservoir(h, "x", "n", 10**6).collect())
    assert all_of == total
    some = [Counter(r.value for r in stats.reservoir(h, "x", "n", 2000, seed).collect()) for seed in (1, 1, 2)]
    assert some[0] == some[1] != some[2] and sum(some[0].values()) == 2000 and all(some[0][k] <= total[k] for k in some[0])
    assert abs(sum(k * n for k, n in some[0].items()) / 2000 - sum(k * n for k, n in total.items()) / sum(total.values())) < 1


def test_functions_for_sql(spark):
    names = register.register(spark)
    r = spark.sql("select sl_reverse_complement('AACG') a, sl_gc_share('GGNA') b, sl_is_homopolymer('TTT') c, sl_overlap_length(1, 5, 3, 9) d, sl_has_flag(17, 16) e, sl_edit_distance('abc', 'abd') f, sl_strip_twin('x_DUP') g").first()
    assert tuple(r) == ("CGTT", 2 / 3, True, 2, True, 1, "x") and len(names) == 10


def test_match_order_and_output_order(spark):
    s = "id string, chr string, start long, end long, svtype string, ins_seq string, gt array<int>, epr double, imprecise boolean, filters array<string>, source string, hpid long, alt_reads int"
    b = spark.createDataFrame([("b1", "c", 100, 200, "DEL", "", [0, 1], 1.0, False, [], None, None, 0)], s)
    c = spark.createDataFrame([("near", "c", 101, 200, "DEL", "", [0, 1], 1.0, False, [], None, None, 50), ("exact", "c", 100, 200, "DEL", "", [1, 1], 0.1, False, ["X"], "DP", 3, 1)], s)
    pairs = variants.candidate_pairs(b, c, variants.Match())
    assert [(r.benchmark_id, r.called_id) for r in variants.best_matches(pairs).collect()] == [("b1", "exact")]
    assert variants.optimal_matches(pairs).count() == 2
    assert [r.id for r in c.union(b).orderBy(*variants.output_order()).collect()] == ["b1", "exact", "near"]
