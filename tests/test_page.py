from pyspark.sql import functions as F

from pagemill.functions import markup, page, urls
from pagemill.operators import pages as ops

def C():
    return markup.canon(F.col("t"))


def select(one, html, selector):
    return one(html, markup.inline_text(page.select_content(C(), F.lit(selector))))


def test_selector_grammar(one):
    html = "<div id=a class='x content'><div>in</div><p>t</div>out"
    for s in (".content", "div.content", "div#a", "#a", "div", "[id]", '[id="a"]', ".missing, #a"):
        assert select(one, html, s) == "in t", s
    assert select(one, html, ".conten") is None
    assert select(one, "<article>x</article><main role=main>q</main>", '[role="main"]') == "q"
    assert select(one, "<!-- <main>no</main> --><MAIN>yes</MAIN>", "main") == "yes"
    assert select(one, '<a title="<main>">k</a><main>yes</main>', "main") == "yes"


def test_default_selectors_in_order(one):
    every = ", ".join(page.DEFAULT_SELECTORS)
    assert select(one, "<article>second</article><div id='content'>first</div>", every) == "first"
    assert select(one, "<p>none</p>", every) is None
    for html in (
        "<main>m</main>", "<div role='main'>m</div>", "<div class='post-content'>m</div>", "<div id='main'>m</div>", "<p class='a post b'>m</p>",
        "<div class='entry-content'>m</div>", "<section class=main-content>m</section>",
    ):
        assert select(one, html, every) == "m", html


def test_selector_choice(spark):
    df = spark.createDataFrame([("c", "u"), (None, "u"), ("", ""), (None, None)], "css string, own string")
    got = [tuple(r.s) for r in df.select(page.content_selector(F.col("css"), F.col("own")).alias("s")).collect()]
    assert got[0] == ("c", "css_selector (backward compatibility/override)")
    assert got[1] == ("u", "user-provided content_selector")
    assert got[2][0].startswith("#content, div#content, article") and got[3] == got[2]


def test_descendants(one):
    html = "<p>0</p><div class=a><i>x</i></div><div class=a id=b><div><p>1</p></div><p>2</p></div><p>3</p>"
    for s, want in ((".a p", "1"), ("#b > p, .a i", "x"), ("div div p", "1"), (".a .a p", None), ("div.a#b p", "1"), ("* p", "1"), ("i p, #b p", "1")):
        assert select(one, html, s) == want, s
    assert select(one, "<div><div>no</div><div class=x>a</div></div>", "div .x") == "a"


def test_unsupported_selectors_are_reported(one):
    assert one("div > p, main", page.selector_supported(F.col("t"))) is False
    assert one("div.a#b[role=main], main", page.selector_supported(F.col("t"))) is True


def test_metadata(one):
    html = """<html lang="zh-CN"><head><title> A &amp; B </title><meta name="Description" content="d"><meta content='k1, k2，k3' name=keywords></head>"""
    m = one(html, page.metadata(C()))
    assert tuple(m) == ("A & B", "d", "zh-CN", ["k1", "k2", "k3"])
    assert tuple(one("<p>x</p>", page.metadata(C()))) == (None, None, None, [])


def test_links(spark):
    html = """<a href="/p">P <b>q</b></a><a href='https://o.example/x'>o</a><a href="//h/p">h</a><a href="../d.pdf?x=1">d</a>
      <a href="#f">f</a><a href="?q">q</a><a href="mailto:a@b">m</a><a name=z>none</a><!-- <a href="/no">no</a> -->"""
    df = spark.createDataFrame([(1, "https://site.example/a/b", html)], "page_id bigint, url string, html string")
    rows = ops.links(df).orderBy("pos").collect()
    assert [(r.absolute, r.kind) for r in rows] == [
        ("https://site.example/p", "internal"), ("https://o.example/x", "external"), ("https://h/p", "external"),
        ("https://site.example/d.pdf?x=1", "internal"), ("https://site.example/a/b#f", "internal"), ("https://site.example/a/b?q", "internal"),
        ("mailto:a@b", "other"),
    ]
    assert rows[0].text == "P q"
    assert [r.filename for r in ops.attachments(ops.links(df)).collect()] == ["d.pdf"]


def test_media(spark):
    html = """<img src="a.png?w=1" alt="A"><img alt="no source"><img src=''><video src="v.mp4"><source src="w.mp4"></video>
      <audio><source src="s.mp3"></audio>"""
    df = spark.createDataFrame([(1, "https://s.example/d/", html)], "page_id bigint, url string, html string")
    n = ops.media_counts(df).first()
    assert (n.images, n.videos, n.audios) == (3, 2, 1)
    assert [(r.original_url, r.alt_text) for r in ops.images(df).collect()] == [("https://s.example/d/a.png?w=1", "A")]


def test_resolve_and_names(spark):
    cases = [
        ("http://h/a/b", "c", "http://h/a/c"), ("http://h", "c", "http://h/c"), ("http://h/a/b/", "../../../c", "http://h/c"),
        ("http://h/a?x=1#f", "#g", "http://h/a?x=1#g"), ("http://h/a?x=1", "?y", "http://h/a?y"), ("http://h/a", "", "http://h/a"),
        ("http://h/a/b", "./..", "http://h/"), ("http://h/a/b", "/x/./y/../z?q=../k", "http://h/x/z?q=../k"),
    ]
    df = spark.createDataFrame(cases, "b string, r string, want string")
    for r in df.select("*", urls.resolve(F.col("b"), F.col("r")).alias("got")).collect():
        assert r.got == r.want, r
    names = spark.createDataFrame([("https://h/a/f.png?x=1",), ("https://h/a/dir/",), ("https://h",)], "t string").select(urls.filename(F.col("t"))).collect()
    assert names[0][0] == "f.png" and names[1][0] == "dir" and names[2][0].startswith("resource_") and len(names[2][0]) == 17
    hosts = spark.createDataFrame([("HTTP://U:p@Ho.St:80/x",), ("https://a b|c/x",), ("x",)], "t string").select(urls.host(F.col("t"))).collect()
    assert [h[0] for h in hosts] == ["ho.st", "a b|c", ""]


def test_density_is_monotone(spark):
    html = "<html><head><title>t</title></head><body><nav>n</nav>" + "".join(
        f"<p><a href='/{'x' * i}'>{'l' * i}</a> {'w ' * (30 - i)}</p>" for i in range(30)
    )
    df = spark.createDataFrame([(html,)], "t string").withColumn("c", C())
    kept = [
        set(df.select(F.split(F.coalesce(page.dense_text(F.col("c"), F.lit(x)), F.lit("")), "\n")).first()[0])
        for x in (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)
    ]
    assert all(b <= a | {""} for a, b in zip(kept, kept[1:]))
    assert len(kept[0]) > len(kept[-1])
    default = df.select(page.dense_text(F.col("c"), F.lit(0.4))).first()[0]
    assert default == df.select(page.dense_text(F.col("c"), F.lit(0.0))).first()[0]
    assert default == df.select(page.dense_text(F.col("c"), F.lit(None).cast("double"))).first()[0]


def test_fallback_and_stage2_input(spark):
    rows = [(1, "u", "<p><a href='/x'>only a link</a></p>"), (2, "u", "<p>plain text that stays</p>"), (3, "u", ""), (4, "u", None)]
    v = {r.page_id: r for r in ops.text_versions(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert v[1].fallback_used and v[1].fit == "only a link" and v[1].fit_html is None
    assert not v[2].fallback_used and v[2].fit == "plain text that stays"
    assert v[3].raw is None and v[3].fit is None and not v[3].fallback_used and v[4].fit is None
    df = spark.createDataFrame([("r", "f", "fh"), ("r", "  ", "fh"), (" ", None, None)], "raw string, fit string, fh string")
    s = df.select(ops.stage2_input(F.col("raw"), F.col("fit"), F.col("fh"), F.lit("ch"), F.lit("h")).alias("s")).collect()
    assert [tuple(r.s) for r in s] == [("cleaned", "f", "fh"), ("raw", "r", "h"), ("none", None, None)]


def test_reduction(spark):
    df = spark.createDataFrame([("abcd", "ab"), ("ab", "abcd"), ("", "x"), (None, None)], "r string, f string")
    got = [tuple(x) for x in df.select(ops.reduction(F.col("r"), F.col("f")), ops.ineffective(F.col("r"), F.col("f"))).collect()]
    assert got == [(0.5, False), (-1.0, True), (None, None), (None, None)]


def test_given_versions(spark):
    df = spark.createDataFrame([("p", "r", "f", "h"), (None, "r", "f", "h"), (None, None, "f", None)], "p string, r string, f string, h string")
    c = F.col
    got = [(tuple(x.v), x.s) for x in df.select(ops.given_versions(c("p"), c("r"), c("f"), c("h")).alias("v"), ops.single_text(c("p"), c("r"), c("f")).alias("s")).collect()]
    assert got == [(("p", "p", None), "p"), (("r", "f", "h"), "r"), ((None, "f", None), "f")]


def test_hostile_pages_stay_linear(spark):
    import time

    from pagemill.operators import extract

    n = 150_000
    rows = [
        "a" + " " * n + "b", "<a " + "x" * n + ">t</a>", "<a href='" + "y" * n + "'>t</a>" * 2, "<nav>" * 3000 + "x", "</nav>" * 3000 + "x",
        "<p class='" + "c " * n + "'>z", "<" * n, "&" * n, "<a " * 20_000, "\n" * n + "x", "\xa0" * n + "<p>" + "\xa0" * n, "<div>" * 2000 + "y",
    ]
    df = spark.createDataFrame([(i, "https://h/", r) for i, r in enumerate(rows)], "page_id int, url string, html string").repartition(8)
    start = time.time()
    v = ops.text_versions(df).select("page_id", F.length("raw"), F.length("fit"))
    assert v.count() == len(rows) and len(v.collect()) == len(rows)
    assert len(extract.extract_by_rules(ops.with_canon(df), "detail").select(F.length("record")).collect()) == len(rows)
    assert time.time() - start < 120


def test_nested_elements_keep_their_whole_text(one):
    from pagemill.operators import extract

    c = markup.canon(F.col("t"))
    assert one('<div class="abstract"><div class="t">Intro</div><p>the rest</p></div><p>x', extract._by_class(c, "abstract")) == "Intro the rest"
    assert one('<ul class="features"><li>a<ul><li>a1</li></ul></li><li>b<li>c</ul><ul><li>d</ul>', extract._items_of(c, "features")) == ["a a1", "b", "c"]
    assert one("<dl><dt>A</dt><dd>1</dd><dd>2</dd><dt>B</dt><dd>3</dd><dt>A<dd>4</dl>", extract._pairs(c)) == {"A": "4", "B": "3"}
    assert one("<dl><dt>A<dd>1<dd>2<dt>B<dd>3</dl>", extract._pairs(c)) == {"A": "1, 2", "B": "3"}
    assert one('<div id="x"><div>a</div>b', markup.to_text(page.select_content(c, F.lit("#x")))) == "a \n b"
    assert one('<div class="a"><div class="a"><i>1</i></div></div><div class="a"><b>2</b></div>', markup.to_text(page.select_content(c, F.lit(".a b")))) == "2"
    assert one("div > p, main", page.unsupported(F.col("t"))) == "div > p" and one("main", page.unsupported(F.col("t"))) is None


def test_many_nested_blocks_stay_linear(one):
    import time

    def seconds(n):
        html = '<div id="content">' + '<div class="b"><div>some text of a block</div></div>' * n + "</div><p>tail"
        start = time.time()
        assert one(html, F.length(page.select_content(markup.canon(F.col("t")), F.lit("#content")))) > 40 * n
        return time.time() - start

    seconds(10)
    small = seconds(5_000)
    assert seconds(20_000) < 8 * small + 5
