"""Main text of pages, and the site style tree."""

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from quarryline.llm import sitetree
from quarryline.llm.common import table
from quarryline.llm.sitetree import Page

CASES = [
    ("<html><body><header>Site</header><div id=cookie-notice>We use</div><main><article><h1>T</h1><p>a <a href=x>b</a> c&nbsp;d &amp;e<p>x<br>y<div class='comments'><p>nice</p></div></article><aside>z</aside></main><form>q</form></body>", "T\na b c d &e\nx y"),
    ("<div>no article <b>bold</b></div><p>second", "no article bold\nsecond"),
    ("<nav><a>1</a><article><p>in unclosed nav</p></article>", "in unclosed nav"),
    ("", ""), (None, ""), ("<article><p>  \n </p></article>", ""),
    ("<article><p>a<span class='ad'>AD</span>b</p><ul><li>1<li>2</ul><script>x</script></article><footer>f</footer>", "ab\n1\n2"),
    ("<article>&lt;p&gt; &eacute; <!-- no --></article>", "<p> é"),
]


@pytest.mark.parametrize("html, want", CASES)
def test_page(html, want):
    assert Page(html or "").text(frozenset()) == want


def test_extract(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(i, "http://h.org/x", h, "t", "n") for i, (h, _) in enumerate(CASES)] + [(0, None, CASES[0][0], None, None), (99, "http://[bad", "<p>" + "long " * 50_000, None, None)]
    got = sitetree.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got if r.url}
    assert [by[i] for i in range(len(CASES))] == [w for _, w in CASES] and len(by[99]) == 250_000 - 1
    assert all(r.n_chars == len(r.text) for r in got)
    assert sitetree.extract(spark.createDataFrame([], schema)).count() == 0


def test_repeated_branches_go(spark, monkeypatch):
    """A branch of no known name that says the same on all pages of a host is noise; the articles stay, even where all are equal."""
    page = lambda i: f"<body><div class='top'><div>Call us today</div></div><article><p>{'same text' if i % 2 else f'text {i}'}</p><div class='tail'>More on this site</div></article></body>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(12)] + [(100, "http://small.org/", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (sitetree.BROADCAST_ROWS, 0):  # sent to all executors, or joined by host
        monkeypatch.setattr(sitetree, "BROADCAST_ROWS", most)
        got = {r.page_id: r.text for r in sitetree.extract(df).collect()}
        assert got[1] == "same text" and got[2] == "text 2" and got[100] == "text 0\nMore on this site"
    assert {r.host for r in sitetree.noise_nodes(df).collect()} == {"h.org"}


def test_repeated_blocks_of_articles_go(spark):
    """Unnamed paragraphs, headings and quotations inside the article that say the same on a host's pages go; a host that repeats an article keeps it."""
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>Read this first</p><p>text {i}</p><h2>About us</h2><blockquote>Notice {i % 2}</blockquote></article></body>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://same.org/{i}", page(1)) for i in range(40)]
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Title 7\ntext 7" and got[107] == "Title 1\nRead this first\ntext 1\nAbout us\nNotice 1"


def test_branches_of_any_depth_go(spark):
    """A branch that repeats goes at any depth; the depth of a page is not bounded."""
    page = lambda i: "<body>" + "<div class='x'>" * 30 + f"<div class='tail'><div>More here</div></div><p>text {i}</p>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in sitetree.extract(df).collect()} == {f"text {i}" for i in range(12)}
    assert sitetree.noise_nodes(df).filter("importance < 0.3").count() >= 2
    assert Page("<div>" * 5000 + "deep").text(frozenset([1])) == "deep"


def test_large_noise_sets_use_the_same_hosts(spark, monkeypatch):
    """Addresses without a scheme, of IPv6 or with two @ have the same host when pages are joined by host."""
    monkeypatch.setattr(sitetree, "BROADCAST_ROWS", 0)
    page = lambda i: f"<article><p>text {i}</p><div>More on this site</div></article>"
    rows = [(i, ("//a.org/x", "http://[::1]/x", "http://u@v@c.org/")[i % 3], page(i)) for i in range(36)]
    got = sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"text {i}" for i in range(36)}


def test_the_tree_alone_finds_the_main_part(spark, sf, monkeypatch):
    """Pages without an article element, all names without meaning, come out as those with one do; without the tree they don't."""
    pages = table(spark, sf, "pages").withColumn("url", F.lit("http://h.org/"))
    want = {r.page_id: r.text for r in sitetree.extract(pages).collect()}
    html = F.col("html")
    for old, new in (("<article", '<div class="q1"'), ("</article", "</div"), ("<(/?)nav", "<$1div"), ("<(/?)footer", "<$1div"), ('class="ad"', 'class="x7"')):
        html = F.regexp_replace(html, old, new)
    renamed = pages.withColumn("html", html)
    assert {r.page_id: r.text for r in sitetree.extract(renamed).collect()} == want
    monkeypatch.setattr(sitetree, "_beside", lambda summed: summed.select("host", "path").limit(0))
    alone = {r.page_id: r.text for r in sitetree.extract(renamed).collect()}
    assert sum(alone[i] == want[i] for i in want) < 0.1 * len(want)


def test_main_text_is_the_articles(spark, sf):
    """Every page's text is what its one article holds, by a plain rule for these regular pages."""

    def plain(html: str) -> str:
        part = re.sub("<(?!/?(?:p|h1|br)\\b)[^>]*>", "", re.search("<article>(.*)</article>", html, re.S)[1])
        blocks = (re.sub(r"\s+", " ", unescape(re.sub("<br>", " ", b))).strip() for b in re.split("</?(?:p|h1)>", part))
        return "\n".join(b for b in blocks if b)

    rows = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    got = {r.page_id: r.text for r in sitetree.extract(table(spark, sf, "pages")).collect()}
    assert got == {i: plain(h) for i, h in rows.items()}
