"""Operators on pages and vectors, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import html_text, packing, topk

PAGES = "page_id long, url string, html string, parts string"


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def text(source):
    return html_text.Page(source).text()


def test_article_without_what_stands_beside_it():
    body = """<header><h1>Site</h1></header><nav><ul><li><a>Menu</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
    <article><header><h1>Head &amp; more</h1></header><p>One <b>bold</b>  word&nbsp;here.<p>Two<br>lines.<div class="share-buttons">Share</div><script>var t="</p>";</script>
    <form><label>Mail</label><input></form><p>Three &lt;3 &#233;</p><section id="comments"><p>First!</p></section></article><aside>Side</aside><footer>&copy; x</footer>"""
    assert text(page(body)) == "Head & more\nOne bold word here.\nTwo lines.\nThree <3 é"


def test_broken_markup():
    assert text(None) == text("") == text("<!-- x") == "" and text("plain <b>text") == "plain text"
    assert text("<p>a<p>b</div></i>c<p>d <unfinished") == "a\nbc\nd"
    assert text("<p>a < b and c > d") == "a < b and c > d"
    assert text('<p title="a > b">x</p><!-- <p>no</p> --><style>p{}</style><p hidden>no</p>') == "x"
    assert text("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>") == "one\ntwo\na\nb\nc"
    assert text("<p>" + "<b>" * 5000 + "deep") == "deep"


def test_inline_parts_that_are_dropped_leave_their_neighbours():
    assert text("<article><p>Hello <span class='ad'>buy</span> world</p></article>") == "Hello world"


def test_recurring_subtrees_go_and_articles_stay(spark):
    shared = "<div><p>All rights reserved, read our terms.</p></div>"
    rows = [(k, f"http://a.example/{k}", page(f"<div><p>Own text number {k} of the site.</p></div>{shared}"), "x") for k in range(8)]
    rows += [(100 + k, "http://b.example/x", page(f"<article><p>Copied article.</p></article>"), None) for k in range(8)]
    rows += [(200 + k, f"http://c.example/{k}", page(f"<div><p>Different {k}</p></div>{shared}"), None) for k in range(2)]
    rows += [(None, None, None, None), (300, None, "", None), (301, "http://a.example/1", rows[1][2], None), (301, "http://a.example/1", rows[1][2], None)]
    got = [tuple(r) for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == len(rows) and by[3][2:] == ("Own text number 3 of the site.", 30)
    assert by[103][2] == "Copied article." and "rights" in by[200][2]  # two pages are too few to tell a template
    assert by[None] == (None, None, "", 0) and by[300][3] == 0 and by[301][2] == by[1][2]
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_generated_pages(spark, small):
    import html as h
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in html_text.op1_html(spark, small).collect():
        s = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        want = [" ".join(h.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|div|ul|li)>", s)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


def unmarked(r, host):
    """A page without article, nav, footer and adverts: its own parts are a div, its site's menu and footer plain blocks."""
    import re

    body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
    menu = "".join(f'<li><a href="/{r.page_id}/{k}">{host} part {k}</a></li>' for k in range(4))
    return page(f"<div><ul>{menu}</ul></div><div>{body}</div><div><p>Copyright {host}</p><p>All rights reserved.</p></div>")


def test_template_step_alone_removes_what_a_site_repeats(spark):
    """With neither article nor marked parts, only counting by host tells a page's own text; without the step, this fails."""
    from collections import Counter

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    host = lambda r: r.url.split("//", 1)[-1].split("/", 1)[0].lower()
    pages = Counter(map(host, rows))
    df = spark.createDataFrame([(r.page_id, r.url, unmarked(r, host(r)), None) for r in rows], PAGES)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    off = {r.page_id: r.text for r in html_text.extract(df, min_pages=10**9).collect()}
    checked = 0
    for r in rows:
        own = text(r.html)
        if pages[host(r)] >= 6:
            checked += 1
            assert got[r.page_id] == own and "All rights reserved." in off[r.page_id]
        elif pages[host(r)] < 5:
            assert got[r.page_id] == off[r.page_id] != own
    assert checked > 100


def test_deep_and_long_pages():
    import time

    began = time.perf_counter()
    assert text("<b>x" * 60_000 + "</i>" * 60_000).count("x") == 60_000
    assert len(text("<div>y" * 20_000).split("\n")) == 20_000
    assert text("<article>" + "<p>z</p>" * 50_000).count("z") == 50_000
    assert time.perf_counter() - began < 30


VECTORS = "vec_id long, embedding array<double>, rank int"


def brute(rows, k=10):
    ok = [(i, np.floor(np.array(x, float) * 1024).astype(object)) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for i, x in ok:
        if i % 100:
            continue
        best = sorted((-int(sum(int(a) * int(b) for a, b in zip(x, y))), j) for j, y in ok if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("step,block", [(1, 3), (4, 64), (64, 2048)])
def test_top_k(spark, step, block):
    r = np.random.default_rng(step)
    rows = [(k, r.normal(size=8).tolist()) for k in range(230)]
    rows += [(1000 + k, rows[5][1]) for k in range(30)]  # ties
    rows += [(400, None), (500, [None] * 8), (600, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [1.0] * 8), (2, [0.5] * 3), (2000, [])]
    df = spark.createDataFrame([(*x, 1) for x in rows], VECTORS)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, step=step, block=block, per_task=2)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_top_k_of_repeated_rows(spark):
    """A query id on two rows has two lists, however the rows are dealt to tasks."""
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=8).tolist()) for k in range(150)]
    df = spark.createDataFrame([(*x, 1) for x in rows], VECTORS)
    twice = df.union(df)
    want = brute(rows + rows)
    for n in (1, 2, 5):
        got = topk.top_k(twice.coalesce(1) if n == 1 else twice.repartition(n), F.col("vec_id") % 100 == 0)
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, topk.top_k(twice, F.col("vec_id") % 100 == 0).collect())) == want


def test_top_k_of_few_huge_and_no_vectors(spark):
    q = F.col("vec_id") % 100 == 0
    few = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (100, [1e8, 1e8])]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame([(*x, 1) for x in few], VECTORS), q).collect())) == brute(few)
    assert topk.top_k(spark.createDataFrame([], VECTORS), q).count() == 0


def test_pruning_drops_candidates_before_the_last_block():
    r = np.random.default_rng(1)
    scale = 2.0 ** -np.arange(32)
    c = np.floor(r.normal(size=(32, 4000)) * scale[:, None] * 1024)
    best = [[]]
    topk.search_block(np.array([-1]), c[:, :1], np.arange(4000), c, 10, 4, best)
    want = sorted(zip((c[:, 0] @ c).astype(int).tolist(), (-np.arange(4000)).tolist()), reverse=True)[:10]
    assert best[0] == want


def test_pipeline(spark, folder, small, odd):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixture", "packing"]
    for at in (small, f"{folder}/odd", f"{folder}/none"):
        docs = spark.read.parquet(f"{at}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs
            docs = stage(spark, docs, at)
            assert docs.columns == columns, name
            docs = spark.createDataFrame(docs.collect(), before.schema)
            if name == "language":
                assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
            if name == "secrets":
                assert docs.count() == before.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at)
        assert pieces.where("start = 0").count() == docs.count()
    run = corpus_pipeline.run(spark, small)
    assert run.columns == [x.split()[0] for x in packing.PIECES.split(", ")] and run.count() > 0
