"""Extraction of main text from pages whose content is known."""

import html
import re

import pytest

from chunkweave.llm.html import extract, main_text
from chunkweave.llm.queries import op10_html_extraction

LONG = "This is a paragraph of the article, long enough to look like text. " * 3

PAGES = [
    ("", ""),
    ("<p>only one", "only one"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><div id='top-menu'><a>Home</a> <a>News</a></div><div class=content><h2>Head &amp; line</h2><p>{LONG}<p>Short.<p>{LONG}<br>after\n break</div><div class='sidebar widget'><p>{LONG}</div><ul><li><a href=1>one</a><li><a href=2>two</a></ul></body>", f"Head & line {LONG.strip()} Short. {LONG.strip()} after break"),
    (f"<body><header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p><script>if (a < b) {{}}</script><form><p>{LONG}</p></form><div class='ad-slot'>Buy</div><table><tr><td>x<td>y</table><p>a<b>b</b>c&nbsp;d &#8364;</article><section id=comments><p>{LONG}</p></section><footer>{LONG}", f"Title {LONG.strip()} x y abc d €"),
    (f"<main><p>{LONG}<div role=alert>We use cookies {LONG}</div><aside>{LONG}</aside></main>", LONG.strip()),
    ("<nav><a>a</a></nav><footer>f</footer>", ""),
    ("<!-- c --><noscript>no</noscript><p>a &lt;b&gt; <i>c</i>", "a <b> c"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_pages(page, want):
    assert main_text(page) == want


def test_broken_pages_do_not_fail():
    for page in ("<", "<p", "</", "<a b='", "<!--", "<![CDATA[", "&#xffffffff;", "</article></p>x", "<div>" * 5000 + "x", "x" * 500_000):
        main_text(page)


def test_articles_of_all_pages(spark, sf):
    source = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op10_html_extraction(spark, sf).collect():
        article = re.search("<article>(.*)</article>", source[r.page_id].html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split()) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


def test_nulls_and_columns(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x", 2), (1, "u", "<p>x", 2)], "page_id long, url string, html string, text int")
    out = extract(df)
    assert out.columns == ["page_id", "url", "text"] and sorted(r.text for r in out.collect()) == ["", "x", "x"]
    assert extract(df.limit(0)).count() == 0
