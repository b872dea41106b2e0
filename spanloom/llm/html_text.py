"""Main text of web pages: what a site repeats is removed, and what a page marks as beside its article.

Element subtrees are hashed: tags and text of the whole subtree, in lower case and without attributes, so that link targets
don't tell equal parts apart. Spark counts on how many different pages of a host each hash occurs; subtrees on at least ``min_pages`` pages and at least the host's pages to the power ``growth`` are template and
are deleted from every page that has them: on 100 pages that is 10, on a million 1,000, so parts of a large host's sections
are template too. Pages with equal text count once, so copies of an article don't make it a template, and an article
element itself is never deleted, nor prose (paragraphs, headings, list items) inside one. Marked parts go by tag, role and
class, also on hosts with few pages.

Text is then taken from the article elements that remain, else from main, else from the body. Block elements end a block;
character references are decoded, white space inside a block becomes one space, empty blocks go, blocks are joined by \\n.

Defined cases: null and empty html give an empty text; a null url counts as a host of its own; broken markup is read as
browsers do in the plain cases (an unclosed tag ends with its parent, an unknown end tag is ignored, an unfinished tag at
the end is dropped); repeated rows are extracted each; a very long or deeply nested page is one row, read without recursion;
other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tidy

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed values of HTML: elements without content, elements whose content is not markup, elements that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul caption".split()
)
#: Start tags that end an open element of the second kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "title", "body", "html", "legend"}
#: Where a start tag stops looking for an open element to end.
WALLS = frozenset("ul ol dl table select td th div section article main body html".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figcaption summary legend".split())
#: Parts beside the article.
DROP_TAGS = frozenset("head nav footer aside form script style noscript template svg math canvas iframe object embed applet audio video button select option optgroup input textarea label fieldset datalist dialog menu title noembed noframes".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices sidebar sidebars side menu menus navbar navigation nav breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist respond reply replies disqus discussion newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations widget widgets pagination pager skip".split()
)
#: For article and main, whose classes often name the page's layout, only these count.
DROP_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply teaser related".split())
DROP_STARTS = ("advert", "sponsor", "cookie", "sidebar", "breadcrumb", "comment", "newsletter", "navbar", "adsby")
WORDS = re.compile(r"[A-Za-z][a-z]*")
UNFINISHED = re.compile(r"</?[a-zA-Z]")
SPACE = re.compile(r"\s+")
KEYS = "page_id long, html_hash long, host long, text_hash long, parts array<long>"


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def beside(tag: str, raw: str, in_article: bool) -> bool:
    """Whether an element is marked as not part of the article."""
    if tag in DROP_TAGS or tag == "header" and not in_article:
        return True
    if not raw or tag in ("html", "body"):
        return False
    a = attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in DROP_ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    named = f"{a.get('class', '')} {a.get('id', '')}"
    if not named.strip():
        return False
    words = [w.lower() for w in WORDS.findall(named)]
    if tag in ("article", "main"):
        return any(w in DROP_ARTICLE for w in words)
    return any(w in DROP_WORDS or w.startswith(DROP_STARTS) for w in words)


class Page:
    """The elements of a page, by number, and its blocks of text.

    tags, parents, dropped and pieces go by element; blocks are (text, element) in page order; hashes are made on demand.
    """

    def __init__(self, source: str | None):
        self.tags, self.parents, self.dropped, self.article, self.content = ["#root"], [-1], [False], [False], [[]]
        self.blocks: list[tuple[str, int]] = []
        self._text: list[str] = []
        self._owner = 0
        self._opened: Counter = Counter()
        self._read(source or "")

    def _flush(self) -> None:
        if self._text:
            text = SPACE.sub(" ", "".join(self._text)).strip()
            if text:
                self.blocks.append((text, self._owner))
            self._text = []

    def _put(self, text: str, stack: list[int]) -> None:
        at = stack[-1]
        # A change of what is kept inside one block, such as a label in a paragraph, must not carry its text over.
        if self._text and self._lost(at) != self._lost(self._owner):
            if self._lost(at):
                self.content[at].append(text)
                return
            self._flush()
        # A block belongs to the outermost element that it has text of. at is open: what began after it lies inside it.
        self._owner = at if not self._text or at <= self._owner else self._owner
        self._text.append(text)
        self.content[at].append(text)

    def _lost(self, at: int) -> bool:
        return self.dropped[at]

    def _open(self, tag: str, raw: str, stack: list[int]) -> int:
        at, up = len(self.tags), stack[-1]
        self.tags.append(tag)
        self.parents.append(up)
        in_article = self.article[up]
        self.dropped.append(self.dropped[up] or beside(tag, raw, in_article))
        self.article.append(in_article or tag in ("article", "main"))
        self.content.append([])
        self.content[up].append(at)
        return at

    def _end(self, tags: frozenset | set, stack: list[int], walls: frozenset) -> bool:
        """Close the nearest open element of tags, unless a wall stands before it; whether there was one."""
        if not any(self._opened[t] for t in tags):
            return False
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in tags:
                self._opened.subtract(self.tags[x] for x in stack[k:])
                del stack[k:]
                return True
            if tag in walls:
                break
        return False

    def _read(self, s: str) -> None:
        stack, at, n = [0], 0, len(s)
        while at < n:
            m = TOKEN.search(s, at)
            stop = m.start() if m else n
            if stop > at:
                text = s[at:stop]
                if not m and UNFINISHED.match(text, cut := max(0, text.rfind("<"))):
                    text = text[:cut]
                if text:
                    self._put(html.unescape(text), stack)
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                closed = self._end({tag}, stack, frozenset() if tag in WALLS or tag in ("p", "html", "body") else WALLS)
                if tag in BLOCKS and (closed or tag == "p"):
                    self._flush()
                continue
            if tag in BLOCKS:
                self._flush()
            if tag in ENDS_P:
                self._end({"p"}, stack, WALLS)
            if tag in CLOSES:
                self._end(CLOSES[tag], stack, WALLS - CLOSES[tag] - {"td", "th"} if tag in ("tr", "tbody", "tfoot") else WALLS - CLOSES[tag])
            if tag in VOID:
                if tag in ("br", "hr", "wbr"):
                    self._text.append(" " if tag != "wbr" else "") if self._text else None
                continue
            here = self._open(tag, m[3], stack)
            if tag in RAW:
                close = re.compile(rf"</{tag}\b", re.I).search(s, at)
                at = close.start() if close else n
                self.content[here].append(s[m.end() : at])
                end = s.find(">", at)
                at = n if end < 0 else end + 1
                continue
            if not m[3].endswith("/") or tag in BLOCKS:
                stack.append(here)
                self._opened[tag] += 1
        self._flush()

    def hashes(self) -> list[int]:
        """For each element, a hash of its tag, its text and those of everything in it, as signed 64-bit."""
        out = [0] * len(self.tags)
        for at in range(len(self.tags) - 1, -1, -1):
            x = xxhash.xxh64(self.tags[at].encode())
            for c in self.content[at]:
                x.update(out[c].to_bytes(8, "little") if isinstance(c, int) else b"\0" + " ".join(c.lower().split()).encode("utf-8", "surrogatepass"))
            out[at] = x.intdigest()
        return [h - (1 << 64) if h >> 63 else h for h in out]

    def candidates(self) -> list[int]:
        """Elements that can be template: blocks below the body with text, but no article nor what holds one.

        Inside an article only containers can be: its paragraphs and headings are prose, however often a site prints them.
        """
        holds = [False] * len(self.tags)
        for at in range(len(self.tags) - 1, 0, -1):
            holds[at] |= self.tags[at] in ("article", "main")
            holds[self.parents[at]] |= holds[at]
        return [at for at in range(1, len(self.tags)) if self.tags[at] in BLOCKS and not holds[at] and self.tags[at] not in ("html", "body", "head", "title") and self.content[at] and not (self.article[at] and self.tags[at] in PROSE)]

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        """The main text without the elements whose hash is in template."""
        lost = list(self.dropped)
        if template:
            hashes, can = self.hashes(), set(self.candidates())
            for at in range(1, len(self.tags)):
                lost[at] = lost[at] or lost[self.parents[at]] or at in can and hashes[at] in template
        inside: dict[str, list[bool]] = {}
        for tag in ("article", "main"):
            inside[tag] = [False] * len(self.tags)
            for at in range(1, len(self.tags)):
                inside[tag][at] = self.tags[at] == tag or inside[tag][self.parents[at]]
        for tag in ("article", "main"):
            found = [t for t, at in self.blocks if inside[tag][at] and not lost[at]]
            if found:
                return "\n".join(found)
        return "\n".join(t for t, at in self.blocks if not lost[at])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for page_id, key, host, source in zip(*(b.column(c).to_pylist() for c in ("page_id", "html_hash", "host", "html"))):
            page = Page(source)
            hashes = page.hashes()
            text = xxhash.xxh64_intdigest(page.text().encode("utf-8", "surrogatepass")) >> 1
            rows.append((page_id, key, host, text, sorted({hashes[at] for at in page.candidates()})))
        cols = list(zip(*rows)) or [()] * 5
        types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "html_hash", "host", "text_hash", "parts"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Page(s).text(frozenset(p or ())) for s, p in zip(b.column("html").to_pylist(), b.column("parts").to_pylist())]
        out = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, min_pages: int = 5, growth: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession, "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(host).alias("host"), F.xxhash64("url", "html").alias("html_hash"))
    parts = scratch.table(keyed.select("page_id", "html_hash", "host", "html").mapInArrow(tidy(_keys), KEYS), "parts")
    # The most frequent part of a large host is one key, but it is counted before rows are sent.
    each = parts.select("host", "text_hash", F.explode("parts").alias("part"))
    seen = each.distinct().groupBy("host", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    sizes = parts.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    template = scratch.table(seen.join(sizes, "host").where(F.col("n") >= F.pow(F.col("of").cast("double"), growth)).select("host", "part"), "template")
    on_page = parts.select("page_id", "html_hash", "host", F.explode("parts").alias("part")).join(template, ["host", "part"], "left_semi")
    removed = on_page.groupBy("page_id", "html_hash").agg(F.collect_set("part").alias("parts"))
    removed = scratch.table(removed, "removed").select(F.col("page_id").alias("r_id"), F.col("html_hash").alias("r_hash"), "parts")
    joined = keyed.join(removed, (keyed["html_hash"] == removed["r_hash"]) & keyed["page_id"].eqNullSafe(removed["r_id"]), "left")
    return joined.select("page_id", "url", "html", "parts").mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
