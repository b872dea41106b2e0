"""File formats, variants, reads and streams on small fixtures."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import predicates
from spanloom.plans import features, reads, variants
from spanloom.sources import readers, vcf, writers
from spanloom.streaming import events

# Hand-made records with the shape of those that a caller writes: literal and symbolic, one sample.
RECORDS = [
    "ref1\t100\tT_INS_0\tA\tAGGTTC\t.\t.\tSVTYPE=INS;SVLEN=5;SVINSLEN=5;SOURCE=REFERENCE_GUIDED_ASSEMBLY\tGT:FT:EPR\t1/1:PASS:0.9",
    "ref2\t30001\tDEL_SR_3\tN\t<DEL>\t.\t.\tEND=50000;SVTYPE=DEL;SVLEN=-19999;SOURCE=2SR;IMPRECISE\tGT:FT:EPR\t0/1:LOW;SHORT:0.4",
    "ref2\t80\tx\tACG\tA\t.\tPASS\tQ=1;Q=2\tGT\t./1",
    "ref2\t90\ty\tA\t<INS>\t.\t.\tSVTYPE=INS;LEFT_SVINSSEQ=AC;RIGHT_SVINSSEQ=GT;AUX_SNPS=95:G,97:T;AUX_INDELS=99:101:\tGT\t0/1",
    "ref2\t91\tz\tA\t<XYZ>\t.\t.\t.\tGT\t0/1",
]


@pytest.fixture(scope="module")
def calls(spark):
    return vcf.parse(spark.createDataFrame([(r,) for r in ["##x", "#CHROM", *RECORDS]], "value string"))


def test_vcf_parser(calls):
    r = {x.id: x for x in calls.collect()}
    assert set(r) == {"T_INS_0", "DEL_SR_3", "x", "y"}  # without END, SVLEN and alleles a record has no end
    a, b, c, d = (r[k] for k in ("T_INS_0", "DEL_SR_3", "x", "y"))
    assert (a.start, a.end, a.ins_seq, a.gt, a.epr, a.filters) == (99, 99, "GGTTC", [1, 1], 0.9, ["PASS"])
    assert (b.start, b.end, b.svtype, b.imprecise, b.filters) == (30000, 49999, "DEL", True, ["LOW", "SHORT"])
    assert (c.end, c.svtype, c.gt, c.info) == (81, "DEL", [1, None], {"Q": "1"})
    assert (d.ins_seq, [x.pos for x in d.aux_snps], [(x.start, x.end, x.ins_seq) for x in d.aux_indels]) == ("AC-GT", [94, 96], [(98, 100, "")])


def test_vcf_encoder_gives_back_the_records(spark, calls):
    lines = vcf.encode(calls, F.lit("A"), F.lit("CG"))
    again = {x.id: x for x in vcf.parse(lines).collect()}
    for x in calls.collect():
        y = again[x.id]
        assert [(x[c], y[c]) for c in ("chr", "start", "end", "svtype", "ins_seq", "gt", "source", "aux_snps", "aux_indels", "imprecise") if x[c] != y[c]] == []


def test_haplotype_id_does_not_depend_on_order(spark, calls):
    flipped = calls.withColumn("aux_snps", F.reverse("aux_snps"))
    ids = lambda df: {r.id: r.hpid for r in vcf.with_haplotype_id(df).collect()}
    assert ids(calls) == ids(flipped) and len(set(ids(calls).values())) == 4


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#c\nchr1\t5\t9\tx\nchr2\t0\t4\n\n")
    (tmp_path / "bad.bed").write_text("chr1\t9\t5\n")
    (tmp_path / "r.fa").write_text(">c1 text\nacg\nTT\n>c2\nGG\n")
    (tmp_path / "r.fai").write_text("c1\t5\t9\t3\t4\nc2\t2\t20\t2\t3\n")
    (tmp_path / "s.txt").write_text("depth . 30\ndepth chr1 28\n")
    (tmp_path / "c.txt").write_text("threads 4\nname a b\n")
    (tmp_path / "gt.txt").write_text("v1 0/1 0 1\nv1 1/1 1 0\nv2 0/0 . .\n")
    (tmp_path / "t.tsv").write_text("LEN\tP\n0\t0.5\n1\t0.25\n")
    (tmp_path / "t2.tsv").write_text("LEN\tP\n0\t0.5\n2\t1.25\n")
    p = str(tmp_path)
    assert [tuple(r) for r in readers.bed(spark, f"{p}/a.bed").orderBy("contig").collect()] == [("chr1", 5, 9), ("chr2", 0, 4)]
    assert readers.inclusive_bed(spark, f"{p}/a.bed").agg(F.max("end")).first()[0] == 8
    with pytest.raises(Exception, match="bad interval"):
        readers.bed(spark, f"{p}/bad.bed").collect()
    assert {tuple(r) for r in readers.fasta(spark, f"{p}/r.fa").collect()} == {("c1", "ACGTT"), ("c2", "GG")}
    assert {(r.contig, r.length) for r in readers.fai(spark, f"{p}/r.fai").collect()} == {("c1", 5), ("c2", 2)}
    assert readers.key_values(spark, f"{p}/c.txt") == {"threads": "4", "name": "a b"}
    table = readers.stats(spark, f"{p}/s.txt")
    df = spark.createDataFrame([("chr1",), ("chr2",)], "contig string")
    assert {(r.contig, r.depth) for r in readers.stat_value(df, "depth", F.col("contig"), table).collect()} == {("chr1", 28), ("chr2", 30)}
    assert {tuple(r) for r in readers.genotype_labels(spark, f"{p}/gt.txt").collect()} == {("v1", "1/1", 1, -1), ("v2", "0/0", None, None)}
    assert readers.calibration(spark, f"{p}/t.tsv", {"LEN": "int", "P": "double"}, "LEN", ["P"]).count() == 2
    with pytest.raises(Exception):
        readers.calibration(spark, f"{p}/t2.tsv", {"LEN": "int", "P": "double"}, "LEN", ["P"]).collect()
    with pytest.raises(ValueError):
        readers.calibration(spark, f"{p}/t.tsv", {"L": "int"})
    fa = readers.fasta(spark, f"{p}/r.fa")
    head = spark.createDataFrame([("c1", 5, None), ("c2", 3, None), ("c3", 1, None)], "contig string, length long, m5 string")
    assert {(r.contig, r.reason) for r in readers.check_reference(fa, head).collect()} == {("c2", "length"), ("c3", "missing")}


def test_manifest_is_whole_and_checked(tmp_path):
    e = [{"name": "a", "n": 1, "path": "/x"}, {"name": "b", "n": 2, "path": "/y"}]
    path = str(tmp_path / "m.json")
    h = writers.manifest(e, path)
    assert h == writers.manifest_hash([{**x, "path": "/elsewhere"} for x in reversed(e)]) and writers.load_manifest(path)["hash"] == h
    text = open(path).read()
    open(path, "w").write(text.replace('"n": 1', '"n": 3'))
    with pytest.raises(ValueError):
        writers.load_manifest(path)


def test_split_sink(spark, tmp_path):
    df = spark.createDataFrame([("a_DUP", True), ("b", False), ("c", None)], "id string, f boolean")
    writers.split_by_flag(df, F.col("f"), f"{tmp_path}/y", f"{tmp_path}/n", "id")
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/y").collect()] == ["a"] and spark.read.parquet(f"{tmp_path}/n").count() == 2


V = "id string, chr string, start long, end long, svtype string, ins_seq string, gt array<int>, epr double, imprecise boolean, filters array<string>"


def make(spark, rows):
    return spark.createDataFrame([(i, "c", s, e, t, ins, gt, epr, imp, []) for i, s, e, t, ins, gt, epr, imp in rows], V)


def test_normalise(spark):
    contigs = spark.createDataFrame([("c", "GGGACACACATTT")], "chr string, seq string")
    v = make(spark, [("d", 6, 8, "DEL", "", [0, 1], 0.5, False), ("i", 8, 8, "INS", "AC", [0, 1], 0.5, False), ("m", 6, 8, "DEL", "", [0, 1], 0.5, True)])
    got = {r.id: (r.start, r.end, r.ins_seq) for r in variants.normalise(v, contigs).collect()}
    assert got == {"d": (2, 4, ""), "i": (2, 2, "AC"), "m": (6, 8, "")}


def test_compare_matches_one_to_one(spark):
    truth = make(spark, [("t1", 100, 300, "DEL", "", [0, 1], 1.0, False), ("t2", 5000, 5000, "INS", "ACGT" * 20, [1, 1], 1.0, False)])
    called = make(spark, [("c1", 110, 305, "DEL", "", [0, 1], 0.9, False), ("c2", 90, 310, "DEL", "", [1, 1], 0.8, False), ("c3", 9000, 9100, "DUP", "", [0, 1], 0.9, False)])
    r = {x.svtype: x for x in variants.compare(truth, called).collect()}
    assert (r["DEL"].b_tp, r["DEL"].fn, r["DEL"].fp) == (1, 0, 1) and r["INS"].fn == 1 and r["DUP"].fp == 1 and r["DUP"].recall is None
    assert r["DEL"].recall == 1.0 and r["DEL"].precision == 0.5


def test_repeats_allow_distant_places(spark):
    a, b = make(spark, [("t", 1000, 1200, "DEL", "", [0, 1], 1.0, False)]), make(spark, [("c", 1700, 1900, "DEL", "", [0, 1], 1.0, False)])
    assert variants.candidate_pairs(a, b, variants.Match()).count() == 0
    rep = spark.createDataFrame([("c", 900, 2500)], "chr string, start long, end long")
    assert variants.candidate_pairs(a, b, variants.Match(), rep).count() == 1


def test_deduplicate(spark):
    v = make(spark, [("a", 100, 300, "DEL", "", [0, 1], 0.5, True), ("b", 101, 300, "DEL", "", [0, 1], 0.4, False), ("e", 101, 301, "DEL", "", [0, 1], 0.4, False)])
    assert sorted(r.id for r in variants.deduplicate(v).collect()) == ["b", "e"]


def test_cohort(spark):
    rows = make(spark, [("a", 100, 300, "DEL", "", [0, 1], 0.9, False), ("b", 100, 300, "DEL", "", [1, 1], 0.8, False), ("x", 120, 310, "DEL", "", [0, 1], 0.99, False), ("z", 9000, 9300, "DUP", "", [0, 1], 0.5, False), ("r", 100, 300, "DEL", "", [0, 0], 0.5, False)])
    rows = rows.withColumn("sample", F.when(F.col("id") == "b", "s2").when(F.col("id") == "x", "s3").otherwise("s1"))
    got = {r.start: r for r in variants.cohort(rows, ["s1", "s2", "s3"]).collect()}
    assert (got[100].n_samples, got[100].s1, got[100].s2, got[100].s3) == (3, "0/1", "1/1", "0/1") and got[9000].s2 is None and len(got) == 2


def test_resolution_of_overlapping_calls(spark):
    v = make(spark, [("a", 10, 20, "DEL", "", [0, 1], 0.9, False), ("b", 10, 20, "DEL", "", [0, 1], 0.8, False), ("h", 100, 120, "DEL", "", [1, 1], 0.9, False), ("s", 110, 130, "DEL", "", [0, 1], 0.7, False), ("k", 200, 210, "DEL", "", [1, 1], 0.9, False), ("l", 205, 215, "DEL", "", [0, 1], 0.5, False)])
    v = v.withColumns({"hopr": F.lit(0.6), "erefa": F.lit(0)})
    got = {r.id: r.gt for r in variants.resolve_overlaps(v).collect()}
    assert got == {"a": [1, 1], "b": [0, 0], "h": [0, 1], "s": [0, 1], "k": [1, 1], "l": [0, 0]}


def test_reconcile_and_predictions(spark):
    base = make(spark, [("a", 1, 2, "DEL", "", None, None, False), ("b", 1, 2, "INS", "A", None, None, False)])
    called = make(spark, [("a", 1, 2, "DEL", "", [0, 1], 0.3, False), ("a_DUP", 1, 2, "DUP", "", [1, 1], 0.8, False)])
    got = {r.id: (r.gt, r.epr) for r in variants.reconcile(base, called).collect()}
    assert got == {"a": ([1, 1], 0.8), "b": ([None, None], None)}
    pred = spark.createDataFrame([("a", 0.9, 0.2, None)], "id string, epr double, hopr double, cnu double")
    assert {r.id: r.gt for r in variants.apply_predictions(base, pred).collect()} == {"a": [0, 1], "b": [None, None]}


def test_expand_and_contained(spark):
    v = make(spark, [("a", 10, 20, "DEL", "", [0, 1], 0.5, False)]).withColumn("aux_indels", F.expr("array(named_struct('start', 30L, 'end', 30L, 'ins_seq', 'AC'))"))
    got = variants.expand_atoms(v).orderBy("start").collect()
    assert [(r.id, r.svtype, r.start, [x.start for x in r.aux_indels]) for r in got] == [("a", "DEL", 10, [30]), ("a_AUX_1", "INS", 30, [10])]
    h = spark.createDataFrame([("big", "c", 0, 100, 0, [(5, "x"), (50, "y")]), ("same", "c", 40, 60, 0, [(50, "y")]), ("other", "c", 40, 60, 0, [(50, "z")])], "id string, chr string, lo long, hi long, priority int, atoms array<struct<pos:long,key:string>>")
    assert sorted(r.id for r in variants.drop_contained(h).collect()) == ["big", "other"]


def test_insertion_that_repeats_gets_a_twin(spark):
    unit = "ACGGTCATTGCA"
    contigs = spark.createDataFrame([("c", "TTTTTT" + unit + "GGGGGG")], "chr string, seq string")
    v = make(spark, [("i", 17, 17, "INS", unit, [0, 1], 0.5, False), ("n", 17, 17, "INS", "TTTTGGGGCCCC", [0, 1], 0.5, False)])
    got = {r.id: (r.svtype, r.start, r.end) for r in variants.split_insertions(v, contigs).collect()}
    assert got["i_DUP"] == ("DUP", 5, 17) and "n_DUP" not in got and len(got) == 3


def read(qname, flag, pos, cigar, mpos, isize, seq="A" * 100, nm=0, mapq=60, mq=60, mc="100M", contig="c", mate="c"):
    return (qname, flag, contig, pos, mapq, cigar, mate, mpos, isize, seq, [30] * len(seq), nm, mq, mc, "")


M = [("M", 100)]


def test_read_predicates(spark):
    rows = [read("p", 99, 100, M, 300, 300), read("long", 97, 100, M, 5000, 5000), read("out", 81, 100, M, 500, 500), read("clip", 99, 100, [("S", 30), ("M", 70)], 300, 300), read("hsr", 99, 100, M, 300, 300, nm=9), read("far", 97, 100, M, 300, 0, mate="d"), read("poly", 99, 100, [("M", 70), ("S", 30)], 300, 300, seq="A" * 70 + "G" * 30)]
    df = spark.createDataFrame(rows, readers.READS)
    got = {r.qname: r.c for r in df.select("qname", predicates.routes(20, 15, 3, 50, 200, 500).alias("c")).collect()}
    assert got["p"] == [] and got["long"] == ["long"] and got["out"] == ["outward"] and got["clip"] == ["sr"] and got["hsr"] == ["hsr"] and got["far"] == ["stable_fwd"]
    assert df.where(predicates.poly_g_clip()).first().qname == "poly"
    x = df.where("qname = 'clip'").select(predicates.unclipped_start(), predicates.end(), predicates.mate_end()).first()
    assert tuple(x) == (70, 170, 400)
    assert {r.qname for r in reads.categorised(df, 200, 500).collect()} == {"p", "long", "out", "clip", "hsr", "far"}


def test_pairs_to_a_deletion(spark):
    rows = [read(f"l{k}", 97, 1000 + k, M, 6000 + k, 5100) for k in range(5)] + [read("lone", 97, 90000, M, 99000, 9100)]
    df = spark.createDataFrame(rows, readers.READS)
    cl = reads.clusters(reads.pair_anchors(df, "long", 200, 500), 300, 100, 3)
    d = reads.pair_deletions(cl).collect()
    assert [(x.start, x.end, x.pairs) for x in d] == [(1104, 6000, 5)]
    pairs = spark.createDataFrame([("c", "a", 1000, 6100, 60, 60), ("c", "r", 2000, 2400, 60, 10)], "contig string, qname string, lo long, hi long, mapq int, mate_mapq int")
    dels = spark.createDataFrame([("c", "v", 1104, 5900)], "contig string, id string, start long, end long")
    labels = reads.pair_labels(pairs, dels, 300, 500)
    assert {r.qname: r.label for r in labels.collect()} == {"a": "alt", "r": "ref"}
    s = reads.pair_support(labels).first()
    assert (s.alt_n, s.ref_n, s.alt_fwd_hq, s.ref_fwd_hq) == (1, 1, 1, 0)


def test_evidence_and_genotype(spark):
    import random

    r = random.Random(2)
    ref = "".join(r.choice("ACGT") for _ in range(2000))
    alt = ref[:1001] + ref[1101:]
    rows = [read(f"a{k}", 99, 920 + k, M, 1200, 300, seq=alt[920 + k : 1020 + k]) for k in range(0, 60, 10)]
    rows += [read(f"r{k}", 99, 940 + k, M, 1200, 300, seq=ref[940 + k : 1040 + k]) for k in range(0, 50, 10)]
    df = spark.createDataFrame(rows, readers.READS)
    v = make(spark, [("d", 1000, 1100, "DEL", "", None, 0.5, False)])
    contigs = spark.createDataFrame([("c", ref)], "chr string, seq string")
    ev, deep = reads.read_evidence(df, v.withColumn("chr", F.lit("c")), contigs, 100)
    g = reads.genotype(ev, deep, v).first()
    assert (g.alt_reads, g.ref_reads, g.gt, g.too_deep) == (6, 5, [0, 1], False)
    ev, deep = reads.read_evidence(df, v, contigs, 100, depth_cap=3)
    g = reads.genotype(ev, deep, v).first()
    assert g.too_deep and g.gt is None


def test_features_and_models(spark):
    rows = [(str(k), "DEL", float(k % 10), float(k % 3), None, int(k % 10 > 4), int(k % 10 > 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "id string, model string, x double, y double, z double, exists int, hom int")
    models = features.train_by_model(df, ["x", "y", "z"], ["DEL", "DUP"], trees=3, depth=2)
    assert set(models) == {"DEL"}
    out = {r.id: r for r in features.apply_models(df.withColumn("model", F.when(F.col("id") == "7", "OTHER").otherwise(F.col("model"))), models).collect()}
    assert len(out) == 200 and out["9"].epr > 0.5 > out["1"].epr and out["7"].epr is None


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:00:00", 3.0), (1, "2024-01-01 00:00:30", 5.0), (1, "2024-01-01 01:00:00", 1.0), (2, "2024-01-01 00:00:10", 9.0)]
    spark.createDataFrame(rows, "k long, t string, v double").select("k", F.col("t").cast("timestamp").alias("t"), "v").write.parquet(src)

    def run(name, f, mode="complete"):
        s = spark.readStream.schema("k long, t timestamp, v double").parquet(src)
        q = f(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    got = run("w", lambda s: events.tumbling_max(s, "k", "t", "v", "1 minute", "1 hour"))
    assert sorted((r.k, r.max, r.n) for r in got) == [(1, 1.0, 1), (1, 5.0, 2), (2, 9.0, 1)]
    got = run("s", lambda s: events.gap_sessions(s, "k", "t", "10 minutes", "1 hour"))
    assert sorted((r.k, r.n) for r in got) == [(1, 1), (1, 2), (2, 1)]
    got = run("c", lambda s: events.sliding_clusters(s, "k", "t", 60, "1 minute"), "append")
    assert sorted((r.k, r.n) for r in got) == [(1, 2), (2, 1)]
