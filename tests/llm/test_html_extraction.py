"""Main text of pages: whole articles of the given pages, planted layouts, faulty markup, and linear time."""

from __future__ import annotations

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from strandsort.llm import html_extraction
from strandsort.llm.html_extraction import main_text

DATA = "/root/testdata/sf0.001"

CASES = {
    "marked parts around an unmarked article": (
        "<body><header class=top><a href=/>Home</a></header><div class='cookie-notice'><p>We use cookies. Accept, please, all of them, now.</p></div>"
        "<div id=content><h1>Title</h1><p>Hello, world. This is text.</p><p>Short.</p><ul><li>one item</li><li>two <a href=x>link</a></li></ul></div>"
        "<div id=comments><div class=comment><p>I think, that this is great! Really, really long comment, with punctuation, and so on.</p></div></div>"
        "<div class='sidebar'>x</div><footer>c</footer>",
        "Title Hello, world. This is text. Short. one item two link",
    ),
    "nothing is marked": (
        "<html><body><div class=a1><a href=1>Home</a> <a href=2>News</a></div><div class=z9><h2>Head</h2><p>Some text, here. With marks, and more words.</p>"
        "<p>Another para, of text. Right.</p></div><div class=b2>short foot</div></body>",
        "Head Some text, here. With marks, and more words. Another para, of text. Right.",
    ),
    "table layout": (
        "<table><tr><td><a href=1>a</a><br><a href=2>b</a></td><td><h1>T</h1><p>Long text, which goes on, and on. Yes.</p><p>More text, here.</p></td></tr></table>",
        "T Long text, which goes on, and on. Yes. More text, here.",
    ),
    "flat page": (
        "<body><h1>Flat</h1><p>First, para. With text and marks, see.</p><p>Second, one. With text.</p><p><a href=a>x</a> <a href=b>y</a></p>",
        "Flat First, para. With text and marks, see. Second, one. With text.",
    ),
    "short article beside a long advert": (
        "<article><h1>A</h1><p>b</p></article><div class=ad>Buy, now! Cheap, cheap, very cheap. So cheap, it is not true, and so on.</div>",
        "A b",
    ),
    "form around the whole page": ("<form><input><div><main><p>Main, text.</p></main></div></form>", "Main, text."),
    "comments and their form inside the article": (
        "<body class='has-sidebar'><main><article class=post><header class='entry-header'><h1>Q</h1></header><p>Foo.</p><form><p>Write a comment, please.</p></form>"
        "<section class='comments'><article class='comment'><p>Nope, no.</p></article></section></article></main>",
        "Q Foo.",
    ),
    "references, inline elements, scripts, comments": (
        "<article>Text only &lt;b&gt; &amp;amp; a&nbsp;b<br>c<script>var a='<p>x</p>'</script>d<!-- no > --> e &#233;&#x41; &am <i>in</i>line</article>",
        "Text only <b> &amp; a b cd e éA &am inline",
    ),
    "unclosed and wrongly nested": ("<article><p><b>x<p>y</b>z<p title='a>b'>q</article>", "x yz q"),
    "no markup": ("just text, here", "just text, here"),
    "cut off": ("<p>Hi.<a hre", "Hi."),
    "hidden": ("<article><p>Seen.</p><p style='display: none'>Not seen.</p><div hidden>Nor this.</div></article>", "Seen."),
    "only menus": ("<nav><ul><li><a href=x>y</a></li></ul></nav><footer>z</footer>", ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_query_against_the_articles_of_all_pages(spark):
    """On the given pages the article stands between its tags; taken from there by hand."""
    got = html_extraction.op12_html_text(spark, DATA)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    found = {r["page_id"]: r for r in got.collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        inner = p["html"].partition("<article>")[2].partition("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert (found[p["page_id"]]["text"], found[p["page_id"]]["n_chars"], found[p["page_id"]]["url"]) == (want, len(want), p["url"])


def test_odd_tables(spark):
    page, want = CASES["table layout"]
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "word, here. " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "HTML2": F.lit(1)})
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_extraction.extract(df.repartition(2)).collect())
    assert got == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, ("word, here. " * 50_000).strip(), 599_999)]
    assert html_extraction.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<p>", "<b>", "<div>", '<a href="', "<!--", "<", "&amp", "<p a='\"' ", "</p>", "<p>word, here</p>", "<i><p>", "a "])
def test_long_faulty_pages_take_linear_time(part):
    began = time.perf_counter()
    main_text(part * 50_000)
    assert time.perf_counter() - began < 8
