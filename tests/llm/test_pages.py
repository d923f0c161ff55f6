import math
import re

import pytest

from causalframe.llm import html_text, url_filter

SF = "/root/testdata/sf0.01"

URLS = [
    (1, "https://A.Example.NET/en/1?x=/de/"), (2, "http://example.net/de/1"), (3, "http://example.net"), (4, "http://net/"), (5, "x://www.example.com/de/5#t"),
    (6, "http://example.com/den"), (7, "http://a.org/fr/"), (8, "http://org/fr"), (9, None), (10, ""), (11, "no scheme.net/"), (12, "http://planet/"),
    (13, "http://example.com/de/?q"), (14, "://notnet/x"), (15, "http://a.b/c\nd"), (16, "http://ÄÖ.net/ü"), (16, "http://ÄÖ.net/ü"), (17, "http://x.com" + "/long" * 2000),
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for _, r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in URLS], "page_id long, url string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule) for r in url_filter.filter_urls(df).collect()}
    assert got == {(i, *plain(u)) for i, u in URLS}
    rows = url_filter.filter_urls(df).collect()
    assert len(rows) == len(URLS)
    by = dict((r, v) for v, r in url_filter.RULES)
    assert all(r.verdict == by[r.rule] for r in rows if r.rule)
    assert all(r.verdict in ("allow", "block") for r in rows)
    assert url_filter.filter_urls(df.where("false")).count() == 0


def codes(text):
    out = [0, 0]
    for c in text:
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        out.append(ord(c) - 96 if "a" <= c <= "z" else 27 if c in "0123456789" else 28 if c == "/" else 29 if c == "." else 30 if c == "-" else 31)
    return [*out, 0]


def test_model(spark):
    """The models against a plain one."""
    texts = [("www.good.example/en/1", True), ("good.example/en/22", True), ("bad-site.test/x.html", False), ("other.test/y?", False)] * 5
    df = spark.createDataFrame(texts, "text string, accepted boolean")
    ratios = [r.ratio for r in url_filter.fit(df, evidence=3).orderBy("gram").collect()]
    assert len(ratios) == 32**3

    def log_p(accepted, a, b, c):
        grams = [tuple(s[i - 2 : i + 1]) for t, y in texts if y == accepted for s in [codes(t)] for i in range(2, len(s))]
        n = lambda f: sum(map(f, grams))
        p = (n(lambda g: g[2] == c) + 1) / (len(grams) + 32)
        p = (n(lambda g: g[1:] == (b, c)) + 4 * p) / (n(lambda g: g[1] == b) + 4)
        if n(lambda g: g[:2] == (a, b)) >= 3:
            p = (n(lambda g: g == (a, b, c)) + 4 * p) / (n(lambda g: g[:2] == (a, b)) + 4)
        return math.log(p)

    for a, b, c in [(0, 0, 7), (0, 7, 15), (7, 15, 15), (29, 5, 24), (3, 3, 3), (28, 27, 0), (31, 0, 0)]:
        assert ratios[(a * 32 + b) * 32 + c] == pytest.approx(log_p(True, a, b, c) - log_p(False, a, b, c))
    s = codes("good.test/1")
    want = sum(float(f"{ratios[(s[i - 2] * 32 + s[i - 1]) * 32 + s[i]]:.9g}") for i in range(2, len(s))) / (len(s) - 2)
    one = spark.createDataFrame([("good.test/1",)], "t string")
    assert one.select(url_filter.scored(one["t"], ratios)).first()[0] == pytest.approx(want)


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li>About</li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div class="ad">Buy now</div><aside>Side</aside>
    <div id="content"><h2>A  title</h2><p>First   paragraph with <b>bold</b> text &amp; more &eacute;.<p>Second one, unclosed, long enough to be content as well.
    <p>Short.<ul><li>An item of the article that is rather long<li>another item</ul><form><input> Send</form><!-- note --></div>
    <section class="comments"><p>Reader says something quite long that should not be in the text of the article at all.</p></section>
    <footer>&copy; 2024</footer></body></html>"""
    assert html_text.main_text(page) == "\n".join([
        "A title", "First paragraph with bold text & more é.", "Second one, unclosed, long enough to be content as well.", "Short.", "An item of the article that is rather long", "another item",
    ])


LONG = "A paragraph of the article that is long enough to be content as well as any other."


@pytest.mark.parametrize("page", [
    f'<body><div class="layout has-sidebar"><article><p>{LONG}</p><p>{LONG}</p></article></div></body>',
    f'<body><div class="post comment-open"><p>{LONG}</p><p>{LONG}</p></div></body>',
    f'<body><div id="page" class="with-nav"><nav>Home</nav><main><p>{LONG}</p><p>{LONG}</p></main></div></body>',
    f'<body><div class="banner"><article><p>{LONG}</p><p>{LONG}</p></article></div></body>',
    f'<article><section id="search-methods"><p>{LONG}</p></section><div id="social-history"><p>{LONG}</p></div></article>',
    f'<div><div class="widget">Buy now</div><div class="nav-links"><a>One</a><a>Two</a></div><p>{LONG}</p><p>{LONG}</p></div>',
    f'<article><p>{LONG} <span class="ad">Buy now</span></p><p>{LONG}</p></article><div class="comments"><p>{LONG * 9}</p></div>',
])
def test_marks_are_hints(page):
    assert html_text.main_text(page) == f"{LONG}\n{LONG}"


def test_ids_of_headings():
    page = f'<article><h2 id="related-work">Related work</h2><p>{LONG}</p><h3 id="search">Search</h3><p>{LONG}</p></article>'
    assert html_text.main_text(page) == f"Related work\n{LONG}\nSearch\n{LONG}"


@pytest.mark.parametrize("page", [
    f'<div>Menu</div><article><h1>A title</h1><div class="body"><p>{LONG * 4}</p></div><section><p>{LONG}</p></section></article><div>Foot</div>',
    f'<div>Menu</div><main><h1>A title</h1><blockquote><p>{LONG * 4}</p></blockquote><p>{LONG}</p></main><div>Foot</div>',
    f'<div>Menu</div><div><h1>A title</h1><div><p>{LONG * 4}</p></div><div><p>{LONG}</p></div></div><div>Foot</div>',
])
def test_region_is_whole(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == f"A title\n{LONG * 4}\n{LONG}"


def test_sections_with_ids():
    page = f'<article><h2 id="related-work">Related work</h2><p>{LONG}</p><section id="discussion"><h3 id="search">Search</h3><p>{LONG}</p></section></article>'
    assert html_text.main_text(page) == f"Related work\n{LONG}\nSearch\n{LONG}"


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<script>", "<nav>a</nav>", "<!-- x"])
def test_no_text(html):
    assert html_text.main_text(html) == ("<" if html == "<" else "")  # a lone < is text, the beginning of a tag is not


@pytest.mark.parametrize("end,kept", [(" x <y holds", True), (" a <b and c", True), (" 3 <4", True), (" <p class=\"a", False), (" <div", False), ("</p", False), ("<!-- more", False), (" <em title", True)])
def test_cut_end(end, kept):
    text = html_text.main_text("<p>we know that" + end)
    assert text == " ".join(("we know that" + end).split()) if kept else text == "we know that"


def test_deep_pages():
    import time

    began = time.time()
    for n in (1000, 8000):
        html = "".join(f"<div class='box-comment' id=a{i}>line {i} of this page " for i in range(n)) + "</foo>" * n
        assert html_text.main_text(html)
        html = "<b>" * n + "words " * 50 + "<p>more</p>" * n
        assert html_text.main_text(html).endswith("more")
    assert time.time() - began < 20


def test_extract(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    out = html_text.extract_text(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        article = re.search(r"<article>(.*)</article>", rows[r.page_id], re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text.split() == " ".join(b for b in blocks if b).split()
    none = spark.createDataFrame([(1, None, "t"), (2, "plain words alone", "t")], "page_id long, html string, text string")
    assert {r.page_id: r.text for r in html_text.extract_text(none).collect()} == {1: "", 2: "plain words alone"}
    assert html_text.extract_text(none.where("false")).count() == 0
    twice = html_text.extract_text(none.union(none)).collect()
    assert sorted((r.page_id, r.text) for r in twice) == [(1, ""), (1, ""), (2, "plain words alone"), (2, "plain words alone")]


def test_clashing_names(spark):
    from causalframe.llm.url_filter import filter_urls
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://a.example.net/en/x", "mine")], "page_id long, url string, HOST string").withColumn("Verdict", F.lit(3))
    out = filter_urls(pages)
    assert set(out.columns) == {"page_id", "url", "host", "path", "rule", "verdict", "url_score"}
    assert out.first().host == "a.example.net" and out.first().rule == "example.net/en/"
