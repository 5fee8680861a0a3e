"""Cleaning against hand-written results, and properties of given and random pages."""

import html as stdlib_html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import entities, markup

# Page, text without skip regions, text with them.
EDGES = [
    (None, None, None), ("", None, None), ("<nav>x</nav>", None, "x"), ("<nav><nav>a</nav>b</nav>c", "c", "a b c"), ("x<footer>y<p>z", "x", "x y \n z"),
    ("</nav>a", "a", "a"), ('<script>var t="</p>";</script>q', "q", "q"), ("<!-- <nav> -->a", "a", "a"), ("<NAV>a</NAV><P>b</P>", "b", "a \n b"),
    ("<navbar>a</navbar>", "a", "a"), ("a<br>b<br/>c", "a \n b \n \n c", "a \n b \n \n c"), ("a<!-- b<p>c", "a", "a"), ("a<script>b<p>c", "a", "a"),
    ("<nav/>a", "a", "a"), ('<a title="x>y">k</a>', "k", "k"), ("a < b <p>c", "a < b \n c", "a < b \n c"), ("1<2<p>x", "1 < 2 \n x", "1 < 2 \n x"),
    ("<nav><footer></nav>x</footer>y", "y", "x y"), ("a <b>　c</b>", "a c", "a c"), ("<p>&nbsp;x&nbsp;</p>", "x", "x"), ("&amp;lt;<p>", "&lt;", "&lt;"),
    ("<nav>" * 60 + "a" + "</nav>" * 59 + "b</nav>c", "c", "a b c"), ("中文，没有空格", "中文，没有空格", "中文，没有空格"),
    ("x" * 200_000 + "<p>" + "y" * 200_000, "x" * 200_000 + " \n " + "y" * 200_000, None), ("<div " + "a='b' " * 3000 + ">t</div>", "t", "t"),
]


def test_edges(spark):
    df = spark.createDataFrame([(i, e[0]) for i, e in enumerate(EDGES)], "i int, html string")
    h = F.col("html")
    for r in df.select("i", markup.clean_text(h).alias("clean"), markup.raw_text(h).alias("raw")).collect():
        _, clean, raw = EDGES[r.i]
        assert r.clean == clean, r.i
        assert raw is None and clean is not None or r.raw == raw, r.i


def test_documented_deviations(one):
    c = markup.clean_text(F.col("t"))
    assert one("a<p>b<di", c) == "a \n b"  # a cut last tag is dropped
    assert one("a<p>b &am", c) == "a \n b &am"  # a cut reference stays as text


def check_properties(page, clean):
    """No markup of the page is left, no skip region's word is there, words keep their order, blank lines don't pile up."""
    if clean is None:
        return
    assert clean == clean.strip() and not re.search(r"\n\s*\n\s*\n|  ", clean)
    assert not re.search(r"</?(?:p|nav|br|aside|td|script|footer|div|b)\b[^<]*>", clean)
    at = 0
    source = stdlib_html.unescape(page)
    for word in re.findall(r"[a-z]{3,}", clean):
        at = source.index(word, at) + len(word)


def test_driver_pages_have_the_properties(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", markup.clean_text(F.col("html")).alias("c")).collect()
    assert rows
    for r in rows:
        check_properties(r.html, r.c)


PIECES = st.lists(
    st.sampled_from(
        ["<nav>", "</nav>", "<aside class='x'>", "</aside>", "<p>", "</p>", "<br/>", "<b>", "</b>", "word", " ", "\n", "\t", "&amp;", "&lt;",
         "&#65;", "é", "<script>if(a<b){}</script>", "<!-- c -->", "<td>", "1 < 2", "<footer>", "</footer>", "\xa0"]
    ),
    max_size=25,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pages=st.lists(PIECES, min_size=40, max_size=40))
def test_random_pages_have_the_properties(spark, pages):
    rows = ["".join(p) for p in pages]
    # Around a region that is skipped anyway nothing changes.
    wrapped = [r + "</nav></aside></footer><nav>hidden<p>hidden</nav>" for r in rows]
    df = spark.createDataFrame(list(zip(rows, wrapped, strict=True)), "html string, wrapped string").coalesce(1)
    for r in df.select("html", *[markup.clean_text(F.col(c)).alias(c[0]) for c in ("html", "wrapped")]).collect():
        check_properties(r.html, r.h)
        assert "hidden" not in (r.w or "")


@pytest.mark.parametrize(
    "text", ["&amp;lt; &#128; &#xD800; &#1234567890123; &#x1F600; &copy &notit; &amp;&amp", "&eacute;&NewLine;&Tab;&bne;&copyright&nosuch;&#0;&#13;", "a & b &; &# x"]
)
def test_references_equal_stdlib(one, text):
    assert one(text, entities.decode_entities(F.col("t"), full=True)) == stdlib_html.unescape(text)
