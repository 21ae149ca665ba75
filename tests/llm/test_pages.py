"""The operators on pages and vectors against brute force, held-out pages, and round trips."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import html_extract, topk, warc

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class='ad'>Buy</div>"
    "<article><h1>Head &amp; line {i}</h1><p><b>First  para<br>more.<p>Second &eacute;.</p><aside>Aside</aside><form><p>Name</p></form><div class='comments'><p>Nice!</p></div><ul><li>One<li>Two</ul></article>"
    "<footer>&copy; x</footer></body></html>"
)
TEXT = "Head & line {i}\nFirst para more.\nSecond é.\nOne\nTwo"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", PAGE.replace("{i}", str(i))) for i in range(40)] + [(40, None, None), (41, "u", ""), (None, "v", "<p>loose"), (3, "http://h/3", PAGE.replace("{i}", "3"))]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))


def test_html(pages):
    counts = html_extract.fit(pages.filter("page_id < 20"))
    got = html_extract.extract(pages, counts).collect()
    assert len(got) == pages.count()
    for r in got:
        if r.page_id is not None and r.page_id < 40:  # half of them held out
            assert r.text == TEXT.replace("{i}", str(r.page_id)) and r.n_chars == len(r.text)
    assert {r.text for r in got if r.page_id in (40, 41)} == {""}
    assert html_extract.extract(pages.limit(0), counts).count() == 0
    assert html_extract.fit(pages.limit(0)) == {}


def test_marginals_are_exact():
    """Sum-product against the sum over all states of a small tree."""
    import itertools

    page = html_extract.Page("<div><p>some text here</p><p>more<b>!</b></p></div>")
    counts = html_extract.observations(html_extract.Page(PAGE))
    model = html_extract.Model(counts)
    n = len(page.tags)
    odds = [sum(model.node.get(f, 0.0) for f in fs) for fs in page.features()]
    total, on = 0.0, [0.0] * n
    for state in itertools.product((0, 1), repeat=n):
        p = model.root[state[0]] * np.prod([model.edge[state[page.parents[i]]][state[i]] for i in range(1, n)]) * np.prod([1 / (1 + np.exp(-o if s else o)) for o, s in zip(odds, state, strict=True)])
        total += p
        on = [a + p * s for a, s in zip(on, state, strict=True)]
    assert model.marginals(page) == pytest.approx([a / total for a in on])


def test_warc(spark, pages):
    big = "x" * 1500
    rows = [(1, "u1", big), (2, "u2", big), (2, "u2", big), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "short"), (6, "u6", "short"), (None, "n", big), (7, "é", "WARC/1.1\r\n\r\n" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.read_archives(spark, warc.archive(df)).cache()
    assert {r.type: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 9, "metadata": 9, "response": 6, "revisit": 3}
    out = warc.assemble(records).collect()
    assert len(out) == 9 and all(r.request is not None and len(r.metadata) == 1 for r in out)
    payloads = [bytes(r.response.payload or b"") for r in out if r.response.type == "response"]
    assert sorted(payloads) == sorted(x.encode() for x in (big, "", "", "short", "short", "WARC/1.1\r\n\r\n" * 200))
    assert all(r.response.payload_digest == hashlib.sha1(bytes(r.response.payload or b"")).hexdigest() for r in out if r.response.type == "response")
    assert warc.assemble(warc.read_archives(spark, warc.archive(df.limit(0)))).count() == 0
    got = {(r.page_id, r.record_type, r.refers_to, r.verified) for r in warc.digested(warc.assemble(records)).collect() if r.payload_bytes == 1500}
    assert {x for x in got if x[1] == "revisit" and x[0] is not None} <= {(1, "revisit", 2, True), (2, "revisit", 2, True)} and (1, "revisit", 2, True) in got


def test_damaged_payload(spark, tmp_path):
    """A payload that doesn't have the digest of its header is reported; the rest is read."""
    import gzip

    df = spark.createDataFrame([(1, "u", "y" * 2000), (2, "v", "z" * 2000)], "page_id long, url string, html string")
    for i, file in enumerate(sorted(__import__("pathlib").Path(warc.archive(df).removeprefix("file:")).glob("part-*"))):
        (tmp_path / f"{i}.warc").write_bytes(gzip.decompress(file.read_bytes()).replace(b"yyyy", b"yxyy", 1))
    got = {r.page_id: r.verified for r in warc.digested(warc.assemble(warc.read_archives(spark, f"file://{tmp_path}/*.warc"))).collect()}
    assert got == {1: False, 2: True}


def test_assembly_follows_names(spark):
    rows = [("r", "response", None), ("q", "request", "r"), ("m", "metadata", "q"), ("lost", "request", "gone"), ("own", "metadata", None)]
    df = spark.createDataFrame(rows, "record_id string, type string, concurrent_to string")
    df = df.selectExpr("*", "'u' AS uri", "'d' AS date", "null AS refers_to", "null AS payload_digest", "0L AS payload_bytes", "true AS verified", "map('a', 'b') AS fields", "cast(null AS binary) AS payload")
    got = {r.capture_id: (r.response is not None, r.request is not None, len(r.metadata)) for r in warc.assemble(df).collect()}
    assert got == {"r": (True, True, 1), "gone": (False, True, 0), "own": (False, False, 1)}


def test_top_k(spark):
    r = np.random.default_rng(1)
    vectors = [[float(x) for x in r.normal(0, 0.2, 8)] for _ in range(300)] + [[0.5] * 8] * 60
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (None, [0.1] * 8), (5, vectors[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = topk.top_k(df, F.col("v_id") % 20 == 0, k=7, shard_rows=64, block_rows=4).collect()
    whole = np.floor(64 * np.array(vectors))
    for q in range(0, 360, 20):
        scores = whole @ whole[q]
        best = sorted((i for i in range(360) if i != q), key=lambda i: (-scores[i], i))[:7]
        assert [(x.vec_id, x.score) for x in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == [(i, int(scores[i])) for i in best]
    assert topk.top_k(df.limit(0), F.col("v_id") % 20 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id in (0, 1)"), F.col("v_id") == 0).count() == 1


PARAGRAPHS = ["A first paragraph of the page, with some words.", "Short", "The third, and a <a href='/l'>link</a> in it.", "7"]


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<div>{}</div>", "<div class='wrap'><div>{}</div></div>", "<section>{}</section>", "{}"])
@pytest.mark.parametrize("inner", ["<p>{}</p>", "<div>{}</div>", "<ul><li>{}</li></ul>", "<table><tr><td>{}</td></tr></table>", "<blockquote>{}</blockquote>", "{}<hr>"])
def test_html_without_article_or_paragraphs(pages, outer, inner):
    """Held-out pages: whichever blocks a page uses, and whether or not it marks its article, all text stays and menus go."""
    model = html_extract.Model(html_extract.fit(pages.filter("page_id < 20")))
    body = outer.format("<h1>Head</h1>" + "".join(map(inner.format, PARAGRAPHS)))
    html = f"<html><head><title>T</title></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class='ad'>Buy</div>{body}<footer>End</footer></body></html>"
    want = ["Head", "A first paragraph of the page, with some words.", "Short", "The third, and a link in it.", "7"]
    assert html_extract.main_text(html, model).split("\n") == want


def test_html_lists_of_links(pages):
    """A list of nothing but links is a menu, unless it stands in the article."""
    model = html_extract.Model(html_extract.fit(pages.filter("page_id < 20")))
    links = "<ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul>"
    assert html_extract.main_text(f"<body><article><p>Text</p>{links}</article></body>", model) == "Text\nOne\nTwo"
    assert html_extract.main_text(f"<body><div>{links}</div><div><p>Text</p><p>More</p></div></body>", model) == "Text\nMore"
    assert html_extract.main_text("<p>loose", model) == "loose"


@pytest.mark.parametrize("part", [
    "<h2 id='related-work'>Kept</h2>", "<section id='social-history'><p>Kept</p></section>", "<div class='article-header'><h2>Kept</h2></div>", "<p class='notice-of-motion'>Kept</p>",
    "<div class='ad-hoc-queries'>Kept</div>", "<h2 id='comments'>Kept</h2>", "<div class='header'><p>Kept</p></div>",
])
def test_html_names_of_parts(pages, part):
    """Names don't take text out of an article; compound ones don't elsewhere. A part of a page without an article goes."""
    model = html_extract.Model(html_extract.fit(pages.filter("page_id < 20")))
    assert html_extract.main_text(f"<body><article><p>Text</p>{part}</article></body>", model) == "Text\nKept"
    if "'header'" not in part:
        assert html_extract.main_text(f"<body><div><p>Text</p>{part}</div></body>", model) == "Text\nKept"
    assert html_extract.main_text("<body><div><p>Text</p></div><div id='footer'><p>End</p></div></body>", model) == "Text"


@pytest.fixture(scope="module")
def model(pages):
    return html_extract.Model(html_extract.fit(pages.filter("page_id < 20")))


@pytest.mark.parametrize(("html", "want"), [
    ("<body><form id='f'><nav>Menu</nav><article><h1>A</h1><p>Text</p></article><p><label>Name</label><input></p></form></body>", "A\nText"),
    ("<body><form id='f'><div><p>A long text of the page, in a form around all of it</p></div><select><option>x</select></form></body>", "A long text of the page, in a form around all of it"),
    ("<body><article><p>A text that is longer than the form</p><form><p>Name</p></form></article></body>", "A text that is longer than the form"),
    ("<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>Lead</p></header><p>Text</p><header>By</header></article></body>", "Title\nLead\nText"),
    ("<body><article><p>Text</p><div class='comment'>Nice</div><div class='newsletter'>Sign</div><section class='user-comments'>Me</section><div id='sidebar'>S</div></article></body>", "Text"),
    ("<body><article class='post comments'><p>Text</p></article><div class='comment-list'><article class='comment-body'><p>Me too</p></article></div><article class='teaser'><p>Next</p></article></body>", "Text"),
    ("<body><div class='cookie-banner'>We use</div><div class='top-nav'>Go</div><div><p>Text</p></div><div class='user-comments'><p>Me</p></div><div class='site-footer'><p>End</p></div></body>", "Text"),
    ("<body><div><h1>A</h1><p>Text</p><h2>Sources</h2><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></div></body>", "A\nText\nSources\nOne\nTwo"),
    ("<body><div class='layout has-sidebar'><p>Text</p></div><div class='no-sidebar'><p>More</p></div></body>", "Text\nMore"),
    ("<body><div class='page sidebar'><h1>A</h1><p>Text</p></div></body>", "A\nText"),
    ("<body><article><pre>x = 1 <span class='comment'># kept</span></pre></article></body>", "x = 1 # kept"),
])
def test_html_parts_and_wrappers(model, html, want):
    """Forms and named blocks around a page, an article's own header, and what readers and sites add to an article."""
    assert html_extract.main_text(html, model) == want


def test_html_deep_markup(model):
    """Tens of thousands of open elements and stray ends take time in proportion to the page."""
    import time

    took = []
    for n in (10_000, 40_000):
        deep = "<b>" * n + "x" + "</i>" * n + "<p>y" * 50 + "<div>" * n + "z"
        began = time.process_time()
        assert html_extract.main_text(f"<body><article>{deep}</article></body>", model).endswith("z")
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1
    assert html_extract.main_text("<body><article>" + "<p>word " * 30_000 + "</article></body>", model).count("\n") == 29_999


def test_warc_in_chunks(spark, monkeypatch):
    """Payloads that are far larger than what a worker hands on at once, in one file, and several gzip members in one archive."""
    import gzip

    rows = [(i, f"u{i}", chr(97 + i) * 300_000) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "CHUNK_BYTES", 500_000)
    got = warc.assemble(warc.read_archives(spark, warc.archive(df))).collect()
    assert sorted(bytes(r.response.payload).decode() for r in got) == [h for _, _, h in rows]
    plain = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r["body"] for r in warc.parse(plain * 2)] == [r["body"] for r in warc.parse(gzip.compress(plain) + gzip.compress(plain))] == [b"abc", b"abc"]
