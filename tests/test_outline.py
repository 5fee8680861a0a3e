"""Outlines, full selectors and mined lists against hand-written results."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import outline
from pagemill.functions.markup import TAG
from pagemill.operators import elements, pages

PAGE = """<div id=a class="x y"><p>one<p class='z'>two <b>bold</b></p><ul><li>i<li class=on>j<ul><li>k</ul><li data-q="a-b c">l</ul><img src=p><br></div><div lang=en-us><p></p></div>"""


def marked(html):
    return html.replace("<", TAG + "<")


def texts(html, selector):
    o = outline.Outline(marked(html))
    return [o.words(o.inner[i], o.end[i]) for i in outline.select(o, selector)]


@pytest.mark.parametrize(
    "selector, want",
    [
        ("p", ["one", "two bold", ""]), ("div > p", ["one", "two bold", ""]), ("p + p", ["two bold"]), ("p ~ ul > li", ["i", "j k", "l"]), ("li li", ["k"]), ("ul ul>li", ["k"]),
        ("li:first-child", ["i", "k"]), ("#a > ul > li:last-child", ["l"]), ("li:only-child", ["k"]), ("li:nth-child(2)", ["j k"]), ("li:nth-child(odd)", ["i", "k", "l"]), ("li:nth-child(-n+2)", ["i", "j k", "k"]),
        ("li:not(.on)", ["i", "k", "l"]), ("li:not(.on, [data-q]):not(:only-child)", ["i"]), ("[data-q^=a]", ["l"]), ("[data-q$='c']", ["l"]), ("[data-q*='b c']", ["l"]), ("[data-q~='a-b']", ["l"]), ("[lang|=en]", [""]), ("[lang=en]", []),
        ("p:empty", [""]), (".x.y > .z", ["two bold"]), ("div.y.z", []), ("nothing, b", ["bold"]), ("*[id]", ["one two bold i j k l"]), ("P.z , b", ["two bold"]), ("[class='x y'] b", ["bold"]),
    ],
)
def test_selectors(selector, want):
    assert texts(PAGE, selector) == want


@pytest.mark.parametrize("selector", ["p:hover", "a::before", "p >", "", "> p", "p,,b", "[a", "li:nth-child(x)", "p:not(", "a b:has(c)", "p{}"])
def test_unsupported_selectors_are_named(spark, selector):
    with pytest.raises(outline.Unsupported):
        outline.compiled(selector)
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    rows = elements.select(pages.with_canon(df), F.lit(selector)).orderBy("page_id").collect()
    assert rows[0].selected.error.startswith("unsupported selector") and rows[0].selected.html is None and rows[1].selected is None


def test_outline_is_balanced():
    """Random tag soup: parents enclose children, siblings don't overlap, places count them."""
    rng = random.Random(1)
    tags = ["div", "p", "li", "ul", "b", "br", "td", "tr", "table", "a"]
    for _ in range(300):
        html = "".join(rng.choice(["<{}>", "</{}>", "<{} class=c/>", "t"]).format(rng.choice(tags)) for _ in range(40))
        o = outline.Outline(marked(html))
        seen = {}
        for i in range(len(o)):
            up = o.parent[i]
            assert o.start[i] < o.inner[i] <= o.end[i] and (up < 0 or (up < i and o.start[up] < o.start[i] and o.end[i] <= o.end[up] and o.depth[i] == o.depth[up] + 1))
            before = seen.get(up, -1)
            assert o.previous[i] == before and (before < 0 or o.end[before] <= o.start[i])
            seen[up] = i


def test_time_is_linear():
    pages_ = {
        "nested": lambda n: f"{TAG}<div class=a>{TAG}<p>{TAG}<a href=/x>x{TAG}</a>" * n, "flat": lambda n: f"{TAG}<li>t {TAG}<a href=/x>x{TAG}</a>{TAG}</li>" * n,
        "wide": lambda n: (f"{TAG}<section>" + f"{TAG}<p>t {TAG}<a href=/x>x{TAG}</a>{TAG}</p>" * (n // 3) + f"{TAG}</section>") * 3, "open": lambda n: f"{TAG}<b>{TAG}<li>" * n,
    }
    for make in pages_.values():
        start = time.time()
        o = outline.Outline(make(10_000))
        outline.select(o, "div > p + div a, div div li:last-child")
        outline.mined(o)
        assert time.time() - start < 10


LISTS = {
    "cards": ("<nav><a href=/1>a long link in a navigation</a><a href=/2>another long link in it</a><a href=/3>third long link of it</a></nav>"
              + "".join(f"<div class='card n{i}'><a href='/c/{i}'><img src=x></a><h2><a href='/c/{i}'>Title {i}</a></h2><p>Words about {i} &amp; more</p><time datetime='2024-01-0{i}'>x</time></div>" for i in (1, 2, 3)),
              [(f"Title {i}", f"https://h.org/c/{i}", f"Words about {i} & more", f"2024-01-0{i}") for i in (1, 2, 3)]),
    "links only": ("<ul>" + "".join(f"<li><a href='{i}.html'>A rather long title of story {i}</a></li>" for i in (1, 2, 3)) + "</ul><p><a href=/x>x</a></p>",
                   [(f"A rather long title of story {i}", f"https://h.org/d/{i}.html", None, None) for i in (1, 2, 3)]),
    "two only": ("<div><p><a href=1>a</a></p><p><a href=2>b</a></p></div>", []),
    "no links": ("<p>a</p><p>b</p><p>c</p><p>d</p>", []),
    "odd one": ("<ol>" + "".join(f"<li><h3><a href=/{i}>T{i}</a></h3><span>May {i}, 2023</span><p>text text {i}</li>" for i in (1, 2)) + "<li>an advertisement without a link</li><li><h3><a href=/3>T3</a></h3><p>text text 3</ol>",
                [("T1", "https://h.org/1", "text text 1", "2023-05-01"), ("T2", "https://h.org/2", "text text 2", "2023-05-02"), ("T3", "https://h.org/3", "text text 3", None)]),
}


def test_lists(spark):
    rows = [(n, "https://h.org/d/page", html) for n, (html, _) in LISTS.items()] + [("null", None, None), ("empty", "", "")]
    df = pages.with_canon(spark.createDataFrame(rows, "page_id string, url string, html string"))
    got = {}
    for r in elements.list_items(df, "page_id").orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.title, r.url, r.preview, r.published_date))
    assert got == {n: want for n, (_, want) in LISTS.items() if want}
    records = {r.page_id: r.record for r in elements.list_records(df).collect()}
    assert len(records) == len(rows) and '"total_count":3' in records["cards"] and '"items":[],"total_count":0' in records["null"]


def test_pages_reach_python_in_small_batches(spark, sf_dir):
    """What a worker holds is a hundred pages, whatever the size of Arrow batches."""
    from pagemill.plans import pages

    for query in (pages.list_records_mined, pages.list_items_mined, pages.page_selectors_full):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
