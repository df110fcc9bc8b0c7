"""Main text of web pages: what HTML or its class names mark as not the article goes, and so do a site's templates.

Each element subtree has a hash of its tags, attributes and text. Spark counts, for each host and subtree, the distinct
texts of pages that hold it, so that copies of a page count once; one that recurs on some such pages of its host is the site's template and is deleted wherever it stands. Inside
an article element only CONTAINERS can be templates: its paragraphs, headings and list items may repeat themselves.
Text outside of articles goes as a template or by its marks, not because there is an article elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import BROADCAST_ROWS, Scratch, chunks

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that end others that are left open, and the elements that they don't look beyond.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("article aside body div footer header main nav section table td th li form".split())

#: Elements that can be templates inside an article too.
CONTAINERS = frozenset("address center details div dl fieldset figure hgroup main ol section table ul".split())

#: Never article text, wherever they stand.
NOT_TEXT = frozenset("head script style title noscript template iframe object embed svg math canvas audio video nav aside footer form button select textarea dialog menu input label".split())
#: Words of a class, id or role that mark such parts.
MARKED = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination footer comment comments disqus respond newsletter subscribe signup login share sharing social related recommended widget toolbar complementary contentinfo search".split())
#: The same, outside of the article only.
MARKED_OUTSIDE = frozenset("header masthead topbar".split())
#: Inside of an article a name marks a part only if its other words say nothing of their own.
PLAIN = frozenset("area bar block box button buttons container content group inner item items left link links list outer panel primary right row secondary section site the top bottom wrap wrapper".split())
#: There, ids of these elements are anchors.
ANCHORS = frozenset("section h1 h2 h3 h4 h5 h6 p span li dt dd td th a figure table".split())
#: What an article element may be instead of the article.
NO_ARTICLE = frozenset("ad ads advert advertisement comment comments promo reply replies sponsored".split())


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOT_TEXT or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    if tag in ("html", "body", "main"):
        return False
    for found in NAMES.finditer(attributes):
        names = [set(re.split(r"[_-]+", n)) for n in (found[1] or found[2] or found[3] or "").lower().split()]
        if tag == "article":
            if any(n <= NO_ARTICLE | PLAIN and n & NO_ARTICLE for n in names):
                return True
        elif in_article:
            anchor = tag in ANCHORS and found[0][:2].lower() == "id"
            if not anchor and any(n & MARKED and n <= MARKED | PLAIN for n in names):
                return True
        elif any(n & MARKED or n & MARKED_OUTSIDE for n in names):
            return True
    return False


class Page:
    """Elements in order of their start tags, each with its parent, and texts with their element and block."""

    def __init__(self, html: str) -> None:
        self.parent, self.tags, self.dropped, self.article, self.hashes = [-1], ["#"], [False], [False], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.parts: list[list[bytes]] = [[]]
        self.block = 0
        stack, at, size = [0], 0, len(html)
        while at < size:
            found = TOKEN.search(html, at)
            start = found.start() if found else size
            if start > at:
                self.text(stack[-1], html[at:start])
            if not found:
                break
            at = found.end() if found.end() > start else start + 1
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCKS:
                self.block += 1
            if found[1]:
                self.end(stack, tag)
                continue
            if tag == "br":
                self.text(stack[-1], " ")
            self.start(stack, tag, found[3].strip())
            if tag in VOID:
                self.close(stack.pop())
            elif tag in RAW:
                stop = re.compile(rf"</{tag}\s*>?", re.I).search(html, at)
                if stop and tag in ("textarea", "title"):
                    self.text(stack[-1], html[at : stop.start()])
                at = stop.end() if stop else size
                self.close(stack.pop())
        while stack:
            self.close(stack.pop())

    def text(self, node: int, text: str) -> None:
        self.texts.append((node, self.block, text))
        if plain := " ".join(text.split()):
            self.parts[node].append(plain.encode())

    def start(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.end_open(stack, {"p"}, SCOPE)
        if tag in CLOSES:
            self.end_open(stack, *CLOSES[tag])
        up = stack[-1]
        inside = self.article[up] or tag == "article"
        stack.append(len(self.tags))
        self.parent.append(up)
        self.tags.append(tag)
        self.dropped.append(self.dropped[up] or boilerplate(tag, attributes, inside))
        self.article.append(inside)
        self.hashes.append(0)
        self.parts.append([tag.encode(), attributes.encode()])

    def end_open(self, stack: list[int], tags: set[str], scope: set[str] | frozenset[str]) -> None:
        """Closes the innermost open element of these tags, unless one of the scope stands before it."""
        for i in range(len(stack) - 1, 0, -1):
            if self.tags[stack[i]] in tags:
                while len(stack) > i:
                    self.close(stack.pop())
                return
            if self.tags[stack[i]] in scope:
                return

    def end(self, stack: list[int], tag: str) -> None:
        """An end tag closes its element and what is open in it; an inline one doesn't close blocks."""
        for i in range(len(stack) - 1, 0, -1):
            if self.tags[stack[i]] == tag:
                while len(stack) > i:
                    self.close(stack.pop())
                return
            if tag not in BLOCKS and self.tags[stack[i]] in BLOCKS:
                return

    def close(self, node: int) -> None:
        self.hashes[node] = h = xxhash.xxh3_64_intdigest(b"\0".join(self.parts[node]))
        if node:
            self.parts[self.parent[node]].append(h.to_bytes(8, "little"))
        self.parts[node] = []

    def subtrees(self) -> set[int]:
        """Hashes of the elements that could be templates, as signed integers; marked ones go anyway."""
        return {h - (h >> 63 << 64) for i, h in enumerate(self.hashes) if self.countable(i) and not self.dropped[i]}

    def countable(self, i: int) -> bool:
        if self.article[i]:
            return self.tags[i] in CONTAINERS
        return i > 0 and self.tags[i] not in ("html", "head", "body", "br")

    def dividers(self) -> set[int]:
        """Paragraphs and other small elements between two articles of one parent, outside of any article."""
        last = {self.parent[i]: i for i, tag in enumerate(self.tags) if tag == "article" and not self.dropped[i]}
        out, begun = set(), set()
        for i, (up, tag) in enumerate(zip(self.parent, self.tags, strict=True)):
            if tag == "article":
                begun.add(up)
            elif up in begun and i < last.get(up, 0) and not self.article[i] and tag not in CONTAINERS:
                out.add(i)
        return out

    def main_text(self, templates: set[int]) -> str:
        dropped, dividers = list(self.dropped), self.dividers()
        for i in range(1, len(dropped)):
            h = self.hashes[i]
            dropped[i] |= dropped[self.parent[i]] or i in dividers or h - (h >> 63 << 64) in templates and self.countable(i)
        out, held, block = [], [], -1
        for node, b, text in self.texts:
            if dropped[node]:
                continue
            if b != block:
                out.append("".join(held))
                held, block = [], b
            held.append(unescape(text))
        out.append("".join(held))
        return "\n".join(x for x in (" ".join(t.split()) for t in out) if x)


def main_texts(space: Scratch, pages: DataFrame, *, min_pages: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of each row.

    text is the page's blocks in page order, one to a line, character references decoded and white space in a block
    made one space; "" if there are none or html is null or empty. It is all of the page that is neither marked as
    something else nor a template, inside of article elements and outside; a paragraph between two articles of one
    parent is taken for a divider. A subtree, inside of an article one of CONTAINERS, is a template if pages of
    its host with min_pages different texts (before templates go) at least have it, however many pages the host has.
    Pages without a host in their url share the host "". Null ids are kept; other columns are left out.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    plain = plain.withColumn("key", F.unhex(F.md5(F.concat_ws("\0", F.coalesce("url", F.lit("")), "html").cast("binary"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            hosts = [host_of(u) for u in batch.column("url").to_pylist()]
            pages = [Page(h) for h in batch.column("html").to_pylist()]
            trees = [list(p.subtrees()) for p in pages]
            texts = [xxhash.xxh3_128_digest(p.main_text(set())) if t else None for p, t in zip(pages, trees, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hosts, pa.string()), pa.array(texts, pa.binary()), pa.array(trees, pa.list_(pa.int64()))], ["key", "host", "whole", "subtrees"])

    seen = space.table(plain.select("key", "url", "html").mapInArrow(count, "key binary, host string, whole binary, subtrees array<long>"))
    places = seen.select("key", "host", "whole", F.explode("subtrees").alias("subtree"))
    counts = places.select("host", "subtree", "whole").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    templates = space.table(counts.where(F.col("n") >= min_pages).select("host", "subtree"))
    of_page = space.table(places.join(templates, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("templates")))
    total = of_page.agg(F.sum(F.size("templates"))).first()[0] or 0
    rows = plain.join(F.broadcast(of_page) if total <= BROADCAST_ROWS else of_page, "key", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [Page(h).main_text(set(t or ())) for h, t in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.select("page_id", "url", "html", "templates").mapInArrow(extract, "page_id long, url string, text string")
