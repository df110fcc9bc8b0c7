"""WARC bundles and main texts of pages."""

import hashlib
import io

import pyarrow as pa
import pytest
import zstandard

from vantor.llm import templates, warc
from vantor.llm.common import scratch

HTML = "<html><body><p>" + "same payload " * 20 + "</p></body></html>"


def test_bundles():
    out = io.BytesIO()
    writer = warc.BundleWriter(out)
    records = [warc.write_record(i, f"http://h/{i}", bytes([i]) * n, hashlib.sha256(bytes([i]) * n).hexdigest(), None, "2020-01-01T00:00:00Z") for i, n in enumerate((0, 1, 100, warc.FRAME_BYTES + 5, 7, 600_000, 600_000))]
    places = [writer.add(r) for r in records]
    writer.close()
    assert len({p[0] for p in places}) > 3
    reader = warc.BundleReader(pa.PythonFile(io.BytesIO(out.getvalue()), mode="r"))
    assert [reader.record(*p) for p in reversed(places)] == records[::-1]
    # any reader of plain Zstandard gets the whole archive
    whole = zstandard.ZstdDecompressor().stream_reader(out.getvalue(), read_across_frames=True).read()
    assert whole == b"".join(records)
    head, payload = warc.read_record(records[2])
    assert head["WARC-Type"] == "response" and head["WARC-Target-URI"] == "http://h/2" and payload == b"\x02" * 100
    with pytest.raises(ValueError):
        warc.BundleReader(pa.PythonFile(io.BytesIO(out.getvalue()[:-1]), mode="r"))


def test_archives(spark):
    rows = [(5, "http://a/5", HTML), (3, "http://a/3", HTML), (9, None, HTML), (3, "http://a/3", HTML), (1, "http://a/1", "short"), (2, "bad url", "short"), (4, "u", None), (6, "u", ""), (None, "u", HTML), (7, "u", "é" * 400_000), (8, "u", "é" * 400_000), (10, "u", "x\r\n\r\ny" * 30)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    with scratch(spark) as space:
        got = warc.read_archives(space, warc.write_archives(space, pages)).collect()
        assert warc.read_archives(space, warc.write_archives(space, pages.limit(0))).count() == 0
    want = []
    for key, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, h in rows if k is not None and h == html and len(data) >= 100]
        first = min(same, default=None)
        revisit = key is not None and first is not None and first < key
        want.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def text(html, known=()):
    return templates.Page(html).main_text(set(known))


def test_article_only():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header>
    <nav><ul><li>Menu</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>Lead
    text<br>goes on<p>Two&nbsp;&lt;x&gt; &#233;<ul><li>one<li>two</ul><aside>see also</aside><div class="social-share">tweet</div>
    <form><label>Mail</label><input></form><table><tr><td>c1<td>c2</table><div id="comments"><p>first!</p></div><noscript>js</noscript></article>
    <div class="cookie-notice">We use</div><footer>end</footer></body></html>"""
    assert text(page) == "A & B\nLead text goes on\nTwo <x> é\none\ntwo\nc1\nc2"


def test_odd_pages():
    assert text("") == "" and text("just words") == "just words"
    assert text("<p>a</p></div></b><p>b") == "a\nb" and text("<article><p>unclosed <b>bold") == "unclosed bold"
    assert text("<p title='a>b'>x</p>") == "x" and text("1 < 2 and <> &unknown; &amp") == "1 < 2 and <> &unknown; &"
    assert text("<script>never closed <p>x") == "" and text("<!-- never closed <p>x") == "" and text("<p>a<") == "a<"
    assert text("<article><p>a</article><p>outside<article>b</article>") == "a\nb"
    assert text("<div hidden>h</div><div style='display:none'>n</div><p>v</p>") == "v"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_templates(spark):
    def page(i, host, menu):
        return (i, f"https://{host}/p{i}", f"<body><div><span>{menu}</span></div><div><p>Words of page {i}</p></div><p>Shared here</p></body>")

    rows = [page(i, "a.org", "Site menu") for i in range(20)] + [page(100 + i, f"h{i}.org", "Site menu") for i in range(4)]
    rows += [(200 + i, "http://b.org/x", f"<article><p>Often said</p><p>{i}</p></article>") for i in range(9)]
    rows += [(300, None, None), (301, "", ""), (None, "no host", "<p>kept</p>"), (3, rows[3][1], rows[3][2])]
    pages = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, key int")
    with scratch(spark) as space:
        got = {(r.page_id, r.url): r.text for r in templates.main_texts(space, pages).collect()}
        assert templates.main_texts(space, pages).count() == len(rows) and templates.main_texts(space, pages.limit(0)).count() == 0
    assert got[7, rows[7][1]] == "Words of page 7"  # the menu and what all pages of the host share are its template
    assert got[101, rows[21][1]] == "Site menu\nWords of page 101\nShared here"
    assert got[204, "http://b.org/x"] == "Often said\n4"  # an article repeats itself without becoming one
    assert got[300, None] == got[301, ""] == "" and got[None, "no host"] == "kept"


def test_templates_and_articles(spark):
    def page(i):
        teasers = "".join(f"<article><h3>Teaser {i} {k}</h3></article>" for k in range(2))
        return (i, f"https://c.org/{i}", f"<body><div class='body'><h1>Title {i}</h1><p>Words of page {i}</p></div><section>{teasers}</section></body>")

    def post(i):
        return (50 + i, f"https://d.org/{i}", f"<p>Before {i}</p><article><div class='x1'><p>Join our list</p></div><p>Often said</p><div class='y'><p>Post {i}</p></div></article>")

    pages = spark.createDataFrame([*map(page, range(6)), *map(post, range(6))], "page_id long, url string, html string")
    with scratch(spark) as space:
        got = {r.page_id: r.text for r in templates.main_texts(space, pages).collect()}
    assert got[3] == "Title 3\nWords of page 3\nTeaser 3 0\nTeaser 3 1"  # teasers don't make the main text go
    assert got[52] == "Before 2\nOften said\nPost 2"  # a site's block goes from the article, its paragraphs stay


def test_copies_and_large_hosts(spark):
    copy = "<body><div><h1>One page</h1></div><p>Held under six addresses</p></body>"
    rows = [(i, f"https://e.org/{i}", f"<!-- {i} -->" + copy) for i in range(6)]
    rows += [(100 + i, f"https://f.org/{i}", ("<div>News menu</div>" if i < 8 else "") + f"<p>Words of page {i}</p>") for i in range(100)]
    with scratch(spark) as space:
        got = {r.page_id: r.text for r in templates.main_texts(space, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(6)} == {"One page\nHeld under six addresses"}  # copies are one page
    assert got[103] == "Words of page 3" and got[150] == "Words of page 50"  # eight pages of a hundred are enough


def test_marks_inside_articles():
    """Comments and adverts go whatever element they are; words that only look like marks stay."""
    page = """<body><article><h2 id="search">On search</h2><p>One</p><div class="related-work"><p>Two</p></div><section id="search"><p>Three</p></section>
    <div class="ad-box">Buy</div><div class="social share">tweet</div></article><article class="comment"><p>first!</p></article><article class="comment-list"><p>second</p></article></body>"""
    assert text(page) == "On search\nOne\nTwo\nThree"


def test_templates_against_brute_force(spark):
    """Random well-formed pages without marks: subtrees as text, counted over the hosts' distinct page texts."""
    import random
    import xml.etree.ElementTree as ET

    rng = random.Random(11)
    blocks = [f"<div><p>Block {i}</p></div>" for i in range(6)] + ["<ul><li>x</li><li>y</li></ul>", "<p>plain</p>", "<div><div><p>deep</p></div><p>Block 1</p></div>"]
    rows = []
    for i in range(60):
        inner = [rng.choice(blocks) for _ in range(rng.randint(0, 5))] + [f"<section><p>Words {rng.randint(0, 30)}</p></section>" for _ in range(rng.randint(0, 2))]
        rng.shuffle(inner)
        rows.append((i, f"https://{rng.choice('ab')}.org/{i}", f"<html><body>{''.join(inner)}</body></html>"))
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(10)]

    def lines(node, gone):
        out = []
        for x in node:
            if ET.tostring(x) not in gone:
                out += [x.text] if x.text else []
                out += lines(x, gone)
        return out

    held = {}
    for _, url, html in rows:
        body = ET.fromstring(html)[0]
        for x in body.iter():
            if x is not body:
                held.setdefault((url[8], ET.tostring(x)), set()).add("\n".join(lines(body, ())))
    gone = {h: {t for (host, t), pages in held.items() if host == h and len(pages) >= 5} for h in "ab"}
    want = {i: "\n".join(lines(ET.fromstring(html)[0], gone[url[8]])) for i, url, html in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    with scratch(spark) as space:
        got = {r.page_id: r.text for r in templates.main_texts(space, pages).collect()}
    assert got == want
    assert any(want[i] != "\n".join(lines(ET.fromstring(html)[0], ())) for i, _, html in rows)  # counting decides


def test_record_ids():
    """Payloads under one id, pages without an id, and addresses with blanks."""
    digest = hashlib.sha256(b"x").hexdigest()
    ids = {warc.read_record(warc.write_record(k, "http://h/a b\n", b"x", d, None, "2020-01-01T00:00:00Z", p))[0]["WARC-Record-ID"] for k, d, p in ((1, digest, "a"), (1, "0" * 64, "b"), (None, digest, "a"), (None, digest, "b"))}
    assert len(ids) == 4 and {warc.key_of(i) for i in ids} == {1, None}
    head, _ = warc.read_record(warc.write_record(1, "http://h/a b\n", b"x", digest, None, "2020-01-01T00:00:00Z"))
    assert head["WARC-Target-URI"] == "http://h/a%20b%0A"
