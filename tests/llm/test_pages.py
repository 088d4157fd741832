"""Pages: archives, URL verdicts, main text."""

import gzip
import hashlib
import io
import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import html_text, url_filter, warc

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
PAGE = "page_id bigint, url string, html string, host string, digest string, canonical string, text string, block string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], PAGE)


LONG = "<p>payload é " * 30
ARCHIVED = [
    (5, "http://a/", LONG), (3, "http://b/", LONG), (9, None, LONG), (3, "http://b/", LONG), (1, "http://c/\r\nX: y", "short"), (2, "http://d", "short"),
    (4, "u", None), (6, "u", ""), (None, "u", "x" * 200), (None, "v", "x" * 200), (7, "u", "WARC/1.1\r\n\r\nWARC-Type: revisit\r\n\r\n" * 9), (8, "u", "y" * 3_000_000),
]


@pytest.mark.parametrize("file_bytes", [1, 1 << 26])
def test_round_trip(spark, tmp_path, file_bytes):
    rows = warc.round_trip(pages(spark, ARCHIVED), f"file://{tmp_path}/w", file_bytes).collect()
    want = []
    for page, _, html in ARCHIVED:
        body = (html or "").encode()
        same = [p for p, _, h in ARCHIVED if (h or "") == (html or "") and p is not None]
        first = min(same) if same and len(body) >= 100 else None
        revisit = first is not None and page != first
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_archives_are_plain_gzip_members(spark, tmp_path):
    warc.write_archives(pages(spark, ARCHIVED), str(tmp_path / "w"))
    data = b"".join(gzip.open(io.BytesIO(p.read_bytes())).read() for p in (tmp_path / "w").glob("*.warc.gz"))
    assert data.count(b"WARC-Record-ID: <urn:page:") == len(ARCHIVED) and LONG.encode() in data


def test_predicates_reach_the_reader_and_payloads_stay_packed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, ARCHIVED), path)
    read = warc.read_archives(spark, path)
    assert read.where("record_type = 'revisit'").count() == 2
    plan = read.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "= revisit" not in plan  # the reader does it, no filter above it
    assert read.where("target_uri = 'http://a/'").count() == 1
    assert read.where("target_uri LIKE 'http://%' AND record_type IN ('response', 'metadata')").count() == 4
    assert warc.read_archives(spark, path, payloads=False).where("payload IS NOT NULL").count() == 0
    reader = warc.WarcReader(path, 1 << 26, True)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)])) == [warc.EqualTo(("payload_bytes",), 3)]
    inflated = 0
    more = warc.WarcReader.more

    def counted(*a):
        nonlocal inflated
        got = more(*a)
        inflated += len(got)
        return got

    monkeypatch.setattr(warc.WarcReader, "more", staticmethod(counted))
    batches = list(reader.read(reader.partitions()[0]))
    assert sum(b.num_rows for b in batches) <= 2 and inflated < 10_000


def test_empty_archives(spark, tmp_path):
    assert warc.round_trip(pages(spark, ARCHIVED).where("false"), str(tmp_path / "w")).count() == 0


URLS = [
    None, "", "no scheme", "http://", "http://X.ORG", "http://x.org/", "HTTP://Example.org/es/a?b#c", "http://a.example.org/en/123", "https://example.org/en/2",
    "http://notexample.org/es/", "ftp://u@h.com:80/fr/x", "http://h.com/de/?://x", "http://h.com?q/de/", "http://h.net/a#b", "x://y://z/p", "http://h.com/fr", "://e.com/de/",
    "http://www.bad.net/a/?utm_source=x&b=2&a=1#f", "http://bad.net:80/a?a=1&b=2", "http://bad.net/A?a=1&b=2", "http://ÀB.Org/\n?x", "http://org/", "http://xorg/",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def test_verdicts(spark):
    listed = spark.createDataFrame([("https://bad.net/a?b=2&a=1&ref=z",), (None,), ("nothing",)] + [(f"http://l{k}.net/",) for k in range(500)], "url string")
    rows = url_filter.judge(pages(spark, [(k, u, "") for k, u in enumerate(URLS)] + [(None, URLS[5], None)]), listed).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        if r["page_id"] is None:
            continue
        host, path = plain_parts(URLS[r["page_id"]])
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if "bad.net" in host and path.startswith("/a") else "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), URLS[r["page_id"]]


@pytest.mark.parametrize("blocks", [1, 64, url_filter.BLOCKS])
def test_list_is_exact_for_any_filter(spark, blocks):
    rng = random.Random(blocks)
    listed = {f"k{rng.randrange(5000)}" for _ in range(800)}
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key")).union(spark.range(500).select(F.lit("hot")))
    got = url_filter.on_list(df, spark.createDataFrame([(k,) for k in listed | {"hot"}], "key string"), "key", "on", blocks).collect()
    assert len(got) == 5500 and {r["key"] for r in got if r["on"]} == listed | {"hot"}
    assert not any(r["on"] for r in url_filter.on_list(df, df.where("false"), "key", "on", blocks).collect())


def side_value(scores, links, side):
    return sum(max(0, s) for s, k in zip(scores, side) if not k) + sum(max(0, -s) for s, k in zip(scores, side) if k) + sum(
        w for a, b, w in links if side[a] != side[b]
    )


def test_minimum_cut():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 10)
        scores = [rng.choice((-2.0, -1.0, 0.0, 0.5, 1.5, 3.0)) for _ in range(n)]
        links = [(a, b, rng.choice((0.3, 0.75, 3.0))) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        found = side_value(scores, links, html_text.minimum_cut(scores, links))
        assert found == pytest.approx(min(side_value(scores, links, s) for s in itertools.product((False, True), repeat=n)))


RICH = """<html><head><title>No</title><style>p {}</style></head><body class="has-sidebar"><header class="site-header"><a href="/">Home</a></header>
<div class="cookie-notice">We use cookies on this site to improve your experience of reading it.</div><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div id="wrapper"><aside class="sidebar"><p>Popular posts of this week, with very many words in it, so that it looks like content.</p></aside>
<main><article class="post"><h1>The &amp; Title</h1><p>First paragraph with a <a href="x">link</a>
  and&nbsp;text.<p>Short.<div class="ad">Buy now our very good product, it is cheap and good for all of you.</div><ul><li>one<li>two</ul>
<script>document.write("<p>no</p>")</script><blockquote>Quoted words &lt;b&gt;</blockquote><form><p>Your mail here, please, for more of our news.</p></form>
<section id="comments"><h3>Comments</h3><p>I like this article a lot, thank you for writing it down for us!</p></section></article></main></div>
<footer><p>&copy; 2020 Someone</p></footer></body></html>"""


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("<nav><a href=x>Menu of the page</a></nav>", ""),
    ("Only a text without any markup, which is long enough.", "Only a text without any markup, which is long enough."),
    ("<p>An open <b>bold and <p>another paragraph, much longer than it.</p>", "An open bold and\nanother paragraph, much longer than it."),
    # no end of the head; names of an article and of a title's box that sound like boilerplate; comments that are articles
    ("<html><head><title>No</title><meta charset=utf-8><body><article><h1>Title</h1><p>The whole article stands here.</p></article>", "Title\nThe whole article stands here."),
    ("<html><head><title>No</title><script>x()</script><p>A page without a body tag, and without an end of its head.</p>", "A page without a body tag, and without an end of its head."),
    ('<article class="legal-news"><h1>Ruling</h1><p>The court has decided on the matter today.</p></article>', "Ruling\nThe court has decided on the matter today."),
    ('<main class="search-results"><p>What was found is told in these many words here.</p></main>', "What was found is told in these many words here."),
    ('<article><div class="post-header"><h1>A title</h1></div><p>And the text of the article below it.</p></article>', "A title\nAnd the text of the article below it."),
    ('<main><article><p>The article itself, with its own words in it.</p></article><section class="comments"><article class="comment">'
     '<p>A reader says that this was good to read, and says so at length.</p></article></section></main>', "The article itself, with its own words in it."),
    (RICH, "The & Title\nFirst paragraph with a link and text.\nShort.\none\ntwo\nQuoted words <b>"),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_long_and_deep_pages():
    many = "<article>" + "<p>Some words here.</p><div class=ad>buy</div>" * 5000 + "</article>"
    assert html_text.main_text(many) == "\n".join(["Some words here."] * 5000)
    assert html_text.main_text("<div>" * 5000 + "word " * 100_000).count("word") == 100_000


def test_extract(spark):
    rows = html_text.extract(pages(spark, [(1, "u", RICH), (1, "u", RICH), (None, None, None)])).collect()
    assert sorted(((r["page_id"], r["url"], r["n_chars"]) for r in rows), key=str) == sorted([(1, "u", 81)] * 2 + [(None, None, 0)], key=str)
    assert html_text.extract(pages(spark, [])).count() == 0


@data
def test_query_keeps_the_articles(spark):
    import html as h
    import re

    rows = html_text.op8_html_text(spark, SF).collect()
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(raw)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", raw[r["page_id"]], re.S)[1]
        lines = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?p>|<br>|</?h1>", body)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])
