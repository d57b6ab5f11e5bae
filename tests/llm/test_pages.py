"""URL filter and HTML extraction."""

import re
from html import unescape

import pytest

from quire.llm import html_extract, url_filter
from quire.llm.common import table

SF = "/root/testdata/sf0.01"


def verdict_of(url, entries):
    """Plain rule walk: (host, path, rule, verdict)."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(listed, -len(h + p), -len(h), v != "block", r, v) for h, p, r, v, listed in entries
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    listed, *_, rule, verdict = min(fits)
    return host, path, None if listed else rule, verdict


URLS = [None, "", "no scheme", "http://", "http://WWW.Example.COM/en/x?y#z", "http://example.com", "https://example.com/en",
        "https://example.com/en/", "https://a.b.example.com/en/deep/er", "https://xexample.com/en/1", "ftp://net/es/1",
        "http://n.net/fr/?q=/es/", "http://spam-farm.example.org?x", "http://a.cheap-pills.example.com/q", "x://y://z/w",
        "http://com/", "http://.com/", "http://Éxample.com/EN/", "http://h.net/es/\nline", "http://example.com/en/", "http://h.org/" + "a" * 9000]


def test_url_filter_rules(spark):
    entries = [tuple(r) for r in url_filter.entry_table(spark).collect()]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in
           url_filter.url_verdicts(pages, url_filter.entry_table(spark)).collect()}
    assert got == {i: verdict_of(u, entries) for i, u in enumerate(URLS)}


def test_url_filter_with_many_entries(spark):
    entries = [(f"h{i % 50}.org", f"/{'abc'[i % 3] * (i % 7)}", f"h{i}", "block" if i % 2 else "allow", i % 5 == 0) for i in range(600)]
    entries = [*{(h, p): (h, p, r, v, x) for h, p, r, v, x in entries}.values()]
    table_ = spark.createDataFrame(entries, "host string, path string, rule string, verdict string, listed boolean")
    urls = [f"http://{'s.' * (i % 3)}h{i % 60}.org/{'abcd'[i % 4] * (i % 9)}" for i in range(700)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, table_).collect()}
    assert got == {i: verdict_of(u, entries) for i, u in enumerate(urls)}
    none = url_filter.url_verdicts(pages, table_.limit(0)).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == 700
    assert url_filter.url_verdicts(pages.limit(0), table_).count() == 0


def test_bloom_filter_holds_every_key(spark):
    e = spark.createDataFrame([(f"h{i}.org", f"/{i}") for i in range(500)], "host string, path string")
    blocks = {r.block: r.word for r in url_filter.bloom_blocks(e, 64).collect()}
    k = e.select(url_filter._key(e.host, e.path).alias("k"))
    for r in k.select(url_filter._block(k.k, 64).alias("b"), url_filter._mask(k.k).alias("m")).collect():
        assert blocks[r.b] & r.m == r.m


def article_text(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    parts = (" ".join(unescape(re.sub(r"</?[a-z]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(p for p in parts if p)


def test_extraction_gives_the_articles(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    got = html_extract.op10_html_extract(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article_text(pages[r.page_id]) and r.n_chars == len(r.text)


FURNITURE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) x = "<p>no</p>";</script></head><body>
<header>Site <b>name</b></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<aside>Links</aside><article><h1>Head &amp; line</h1><p>First  <i>para</i>graph<br>goes &lt;on&gt; 5 < 6.
<p>Second &eacute;&#33;<div class="advert">Buy</div><form><input><label>Mail</label></form><ul><li>one<li>two</ul>
<!-- <p>hidden</p> --><section class="comments"><p>Reader says</p></section></article><footer>&copy; me</footer></body></html>"""


def extract(spark, rows):
    df = spark.createDataFrame([(i, u, h, 1) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text int")
    return [r.text for r in html_extract.extract_main_text(df).orderBy("page_id").collect()]


def test_furniture_is_left_out(spark):
    want = "Head & line\n\nFirst paragraph goes <on> 5 < 6.\n\nSecond é!\n\none\n\ntwo"
    assert extract(spark, [("http://a.org/1", FURNITURE)] * 2) == [want, want]


PLAIN = ("<html><body><div id=top><ul><li><a href=/a>Alpha section</a><li><a href=/b>Beta section</a></ul></div>"
         "<div id=content><p>{}</p><p>{}</p></div><div class=footer>Imprint of the house</div></body></html>")


def test_main_element_is_deduced_from_the_host(spark):
    rows = [(f"http://b.org/{i}", PLAIN.format(f"Long text number {i} " * 9, f"end {i}")) for i in range(6)]
    assert extract(spark, rows) == ["\n\n".join((("Long text number %d " % i * 9).strip(), f"end {i}")) for i in range(6)]


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("   ", ""), ("plain  text &amp; more", "plain text & more"), ("<p>a<p>b", "a\n\nb"),
    ("<article>cut off <b>bold", "cut off bold"), ("</div></p>x", "x"), ("<div a='>'>q</div>", "q"), ("a < b > c", "a < b > c"),
    ("<article>one</article><p>x</p><article>two</article>", "one\n\ntwo"), ("<script>never ends", ""), ("<!-- never ends", ""),
    ("<table><tr><td>a<td>b</table>", "a b"), ("<main>x" + "y" * 50_000 + "</main>", "x" + "y" * 50_000)])
def test_odd_pages(spark, page, want):
    assert html_extract.main_text(page or "", frozenset(), None) == want


@pytest.mark.parametrize("page", [
    "<html class='no-banner'><body class='has-sidebar'><nav>Home</nav><article>kept</article></body></html>",
    "<body id=page-with-header><article class='post social'><p>kept</p><div class=social>Share</div></article></body>",
    "<main class=notices><p>kept<aside>no</aside></main>", "<body class='has-sidebar'><div><p>kept</p></div><div class=sidebar>no</div>"])
def test_class_words_of_whole_elements_drop_no_page(spark, page):
    assert extract(spark, [("http://d.org/1", page)]) == ["kept"]


def test_extraction_cases(spark):
    rows = [(None, None), ("", ""), ("http://c.org/1", "<p>x"), ("http://c.org/1", "<p>x")]
    assert extract(spark, rows) == ["", "", "x", "x"]
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_main_text(df).count() == 0
