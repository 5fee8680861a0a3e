"""Queries over the page table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagemill.functions import markup, page, urls, values
from pagemill.operators import crawl, elements, extract, frontier, media, pages as ops, runs
from pagemill.plans import sqltext as q
from pagemill.plans.inputs import heavy, spread, table, text


def _rich(pages):
    """Pages with what the given ones lack: metadata, links to other hosts and to mail, players, and pages of links only."""
    i = F.col("page_id")
    ad = F.regexp_extract("html", '<div class="ad">([^<]*)</div>', 1)
    meta = F.concat(
        F.lit("<head>"), F.when(i % 3 == 0, F.concat(F.lit('<meta name="description" content="'), ad, F.lit('">'))).otherwise(F.lit("")),
        F.when(i % 4 == 0, F.lit('<meta name="keywords" content="one, two，three">')).otherwise(F.lit("")),
        F.when(i % 5 == 0, F.lit('<meta name="author" content="A. Writer">')).otherwise(F.lit("")),
        F.when(i % 5 == 1, F.lit('<meta property="article:published_time" content="2024-2-3">')).otherwise(F.lit("")),
    )
    link = F.when(i % 4 == 1, F.lit("https://other.example.org/")).when(i % 4 == 2, F.lit("mailto:a@b.example?")).otherwise(F.lit("/"))
    players = F.concat(
        F.repeat(F.lit('<video src="/v.mp4"></video>'), (i % 3).cast("int")), F.repeat(F.lit('<audio><source src="/a.mp3"></audio>'), (i % 2).cast("int")), F.lit("<footer>")
    )
    rich = F.replace(F.replace(F.replace("html", F.lit("<head>"), meta), F.lit('<nav><ul><li><a href="/'), F.concat(F.lit('<nav><ul><li><a href="'), link)), F.lit("<footer>"), players)
    links_only = F.concat(F.lit('<html><body><p><a href="/q">'), F.coalesce(F.nullif(ad, F.lit("")), F.lit("q")), F.lit("</a></p></body></html>"))
    return pages.withColumn("html", F.when(i % 11 == 6, links_only).otherwise(rich))


def page_clean_text(spark, sf_dir):
    return heavy(spark, sf_dir, "pages").select("page_id", markup.clean_text(F.col("html")).alias("clean"))


def page_raw_vs_clean(spark, sf_dir):
    v = ops.text_versions(_rich(heavy(spark, sf_dir, "pages")))
    raw, fit = F.col("raw"), F.col("fit")
    return v.select(
        "page_id", F.length(raw).alias("raw_len"), F.length(fit).alias("fit_len"), F.md5(raw).alias("raw_md5"),
        F.md5(fit).alias("fit_md5"), F.round(ops.reduction(raw, fit), 6).alias("reduction"),
        ops.ineffective(raw, fit).alias("ineffective"), "fallback_used",
    )


def host_cleaning_stats(spark, sf_dir):
    """Flagship: clean every page, account for the effect per host."""
    staged = ops.with_canon(heavy(spark, sf_dir, "pages").select("url", "html"))
    sized = staged.select(
        urls.host(F.col("url")).alias("host"),
        F.coalesce(F.length(markup.to_text(F.col("canon"))), F.lit(0)).alias("raw_len"),
        F.coalesce(F.length(markup.to_text(markup.drop_regions(F.col("canon")))), F.lit(0)).alias("clean_len"),
    )
    return ops.cleaning_stats(sized, "host")


def page_select_content(spark, sf_dir):
    """Selector resolution with a task setting on a part of the pages, then the selected element's text."""
    p = ops.with_canon(heavy(spark, sf_dir, "pages"))
    css = F.when(F.col("page_id") % 5 == 1, F.lit("div.ad"))
    own = F.when(F.col("page_id") % 5 == 2, F.lit("h1")).when(F.col("page_id") % 5 == 3, F.lit(".missing"))
    chosen = p.withColumn("sel", page.content_selector(css, own))
    hit = chosen.withColumn("element", page.select_content(F.col("canon"), F.col("sel.selector")))
    return hit.select(
        "page_id", F.col("sel.reason").alias("reason"), F.col("element").isNotNull().alias("found"),
        markup.to_text(F.coalesce("element", "canon")).alias("content"),
    )


def page_density_prune(spark, sf_dir):
    p = ops.with_canon(heavy(spark, sf_dir, "pages"))
    return p.select("page_id", page.dense_text(F.col("canon"), F.lit(0.0)).alias("fit"))


def page_metadata(spark, sf_dir):
    m = ops.with_canon(_rich(heavy(spark, sf_dir, "pages"))).select("page_id", page.metadata(F.col("canon")).alias("m"))
    return m.select("page_id", "m.title", "m.description", "m.language", F.size("m.keywords").alias("n_keywords"))


def page_links(spark, sf_dir):
    return ops.links(_rich(heavy(spark, sf_dir, "pages"))).drop("url")


def host_link_stats(spark, sf_dir):
    """Link and media counts per host of the page."""
    links = ops.links(_rich(heavy(spark, sf_dir, "pages")))
    return links.groupBy(urls.host(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(F.col("kind") == "internal").alias("internal"),
        F.count_if(F.col("kind") == "external").alias("external"),
        F.count_distinct("absolute").alias("distinct_targets"),
    )


def _pictured(spark, sf_dir):
    """Pages whose navigation links became pictures, which the given pages lack."""
    html = F.regexp_replace("html", r'<li><a href="([^"]*)">([^<]*)</a></li>', '<li><img src="$1.png?w=1" alt="$2"></li>')
    return heavy(spark, sf_dir, "pages").withColumn("html", html)


def page_media(spark, sf_dir):
    """Images of each page and their download state against an index of stored files."""
    found = ops.images(_pictured(spark, sf_dir))
    rows = found.select(
        text("doc-", F.col("page_id")).alias("document_id"), text("run-", F.col("page_id") % 7).alias("run_id"), "pos",
        "original_url", "alt_text", (F.col("page_id") % 5 == 0).alias("downloaded"),
        (F.col("page_id") % 3 != 0).alias("fallback_enabled"), F.lit(1).alias("max_size_mb"),
        F.to_date(F.lit("2024-01-02")).alias("run_date"),
    )
    # A stored file exists for pictures with an even number of characters in their URL; sizes cross the limit.
    size = F.length("original_url").cast("bigint")
    blobs = (
        found.select("original_url").distinct().where(size % 2 == 0)
        .select("original_url", (size * 20000).alias("length"), F.lit("image/png").alias("mime_type"))
    )
    return media.resolve_media(rows, blobs)


def page_media_counts(spark, sf_dir):
    return ops.media_counts(_rich(_pictured(spark, sf_dir))).drop("url")


def page_stage2_input(spark, sf_dir):
    v = ops.text_versions(heavy(spark, sf_dir, "pages"))
    blanked = F.when(F.col("page_id") % 4 == 1, F.lit("  ")).otherwise(F.col("fit"))
    raw = F.when(F.col("page_id") % 8 == 5, F.lit(None).cast("string")).otherwise(F.col("raw"))
    s = v.select("page_id", ops.stage2_input(raw, blanked, F.col("fit_html"), F.col("html"), F.col("html")).alias("s"))
    return s.select("page_id", "s.source", F.md5("s.content").alias("content_md5"), F.col("s.html").isNotNull().alias("has_html"))


def url_canonical(spark, sf_dir):
    u = F.col("url")
    refs = {
        "r_root": "/a/./b/../c?x=1", "r_up": "../up/x.pdf", "r_name": "name", "r_query": "?q=2", "r_fragment": "#f",
        "r_scheme": "//cdn.example.org/p", "r_full": "https://other.example.org/z",
    }
    return heavy(spark, sf_dir, "pages").select(
        "page_id", urls.host(u).alias("host"), urls.filename(u).alias("filename"),
        *(urls.resolve(u, F.lit(r)).alias(name) for name, r in refs.items()),
    )


def page_article_records(spark, sf_dir):
    p = extract.extract_by_rules(ops.with_canon(_rich(heavy(spark, sf_dir, "pages"))), "article")
    g = lambda k: F.get_json_object("record", f"$.{k}").alias(k)
    return p.select("page_id", g("title"), g("author"), g("published_date"), g("content"), F.get_json_object("record", "$.keywords").alias("keywords"))


def page_list_records(spark, sf_dir):
    p = extract.extract_by_rules(ops.with_canon(heavy(spark, sf_dir, "pages")), "list_page")
    return p.select(
        "page_id", F.get_json_object("record", "$.page_title").alias("page_title"),
        F.get_json_object("record", "$.total_count").cast("int").alias("total_count"),
        F.get_json_object("record", "$.items[0].url").alias("first_url"),
        F.get_json_object("record", "$.items[5].title").alias("sixth_title"),
    )


# Lists written into the given pages, between two link columns that aren't marked as navigation. ``{j}`` counts the members.
_MEMBERS = (
    ("<ul class='news'>", "<li class='n{j}'><a href='/s/{i}-{j}'>Story {i}-{j} of many</a> <time datetime='2024-0{d}-15T08:00:00'>mid month</time><p>About <b>part {j}</b> of {u}</p></li>", "</ul>"),
    ("<div>", "<div class='card odd'><a href='https://n.example.org/{i}/{j}?x=1&amp;y=2'><h3>Story <i>{i}-{j}</i> of many</h3></a><span class='date'>15.0{d}.2024</span><div><p>About</p><p>About part {j} of {u}</p></div></div>", "</div>"),
    ("<table><tbody>", "<tr><td><h4><a href='../s/{i}-{j}'>Story {i}-{j} of many</a></h4><td>{d}<td><p>About part {j}\n of {u}<td><a href='/more'>more</a></tr>", "</tbody></table>"),
)
_COLUMN = "<div class='side'><ul><li><a href='/h1'>Home</a></li><li><a href='/h2'>Products and services</a></li><li><a href='/h3'>Contact</a></li><li><a href='/h4'>Imprint</a></li></ul></div>"


def _listed(spark, sf_dir):
    """Pages with a list of three to six members behind their start."""
    i, site = F.col("page_id"), F.regexp_replace("url", "[?#].*$", "")

    members = F.sequence(F.lit(1), (i % 4 + 3).cast("int"))
    made = F.lit("")
    for k, (start, one, end) in enumerate(_MEMBERS):
        body = F.array_join(_each(members, one, i, site), "\n")
        made = F.when(i % 3 == k, F.concat(F.lit(start), body, F.lit(end))).otherwise(made)
    around = F.concat(F.lit("<html><body>" + _COLUMN), made, F.lit(_COLUMN), F.regexp_replace("html", "(?i)<!doctype[^>]*>", ""))
    return heavy(spark, sf_dir, "pages").select("page_id", "url", around.alias("html"))


def _each(members, template: str, i, site):
    return F.transform(members, lambda m: F.concat(*_filled(template, i, m, site)))


def _filled(template: str, i, j, site):
    given = {"{i}": i.cast("string"), "{j}": j.cast("string"), "{d}": (i % 9 + 1).cast("string"), "{u}": site}
    return [given.get(x, F.lit(x)) for x in re.split(r"(\{[ijdu]\})", template) if x]


def list_items_mined(spark, sf_dir):
    """Records of each page's list, found by their regular build among other links."""
    return elements.list_items(ops.with_canon(_listed(spark, sf_dir)), "page_id")


def list_records_mined(spark, sf_dir):
    """The same records as one JSON text per page."""
    r = elements.list_records(ops.with_canon(_listed(spark, sf_dir)))
    g = lambda k: F.get_json_object("record", k)
    return r.select(
        "page_id", g("$.total_count").cast("int").alias("total_count"), g("$.items[2].title").alias("third_title"), g("$.items[2].url").alias("third_url"),
        g("$.items[0].description").alias("first_description"), g("$.items[0].date").alias("first_date"),
    )


# Selectors and the text of the first element of the part that ``_marked_up`` puts in front of a page.
_PICKS = (
    ("#top > div > p", "first {i}"), ("#top p + p", "second {u}"), ("#top p~p.note", "second {u}"), ("#top li:first-child a", "A{i}"),
    ("#top li:not(.on):last-child > a", "C{i}"), ("div#top li:nth-child(2)", "B{i}"), ('#top [data-k^="x-"]', "deep {i}"), ("#top a[hreflang|=en]", "C{i}"),
    (".nowhere, #top p[class~=note], #top", "second {u}"), ("#top > .box p:last-child", "deep {i}"), ("#top li:nth-child(2n+1):not(:first-child)", "C{i}"),
    ("#top *[data-k$='-z']", None), ("p:hover", None), ("#top > p", None), ("#top div div > p[data-k*='x']", "deep {i}"),
)


def page_selectors_full(spark, sf_dir):
    """One selector per page out of all kinds: the first element's text, the number of elements, or the error."""
    i, site = F.col("page_id"), F.regexp_replace("url", "[?#].*$", "")
    front = (
        "<div id='top' class='box main-x'><ul class=menu><li><a href='/a'>A{i}</a><li class='on'><a href='/b'>B{i}</a></li><li><a href='/c' hreflang='en-us'>C{i}</a></ul>"
        "<div class='box'><p>first {i}<p class='lead note'>second {u}</p><div><p data-k='x-{i}'>deep {i}</p></div><p>last {i}</p></div></div>"
    )
    p = heavy(spark, sf_dir, "pages").select("page_id", F.concat(*_filled(front, i, i, site), F.col("html")).alias("html"))
    which = F.get(F.array(*[F.lit(s) for s, _ in _PICKS]), (i % len(_PICKS)).cast("int"))
    found = elements.select(ops.with_canon(p), which)
    return found.select("page_id", elements.text_of(F.col("selected")).alias("picked"), (F.col("selected.n") > 0).alias("any"), F.col("selected.error").alias("error"))


def list_to_detail_frontier(spark, sf_dir):
    p = extract.extract_by_rules(ops.with_canon(heavy(spark, sf_dir, "pages")), "list_page")
    return frontier.items_frontier(p.withColumnRenamed("record", "structured_data"))


def product_records(spark, sf_dir):
    """Product pages written from the part table, read back as records."""
    html = F.concat(
        F.lit("<html lang='zh'><head><title>x</title><meta name='description' content='"), F.col("p_type"),
        F.lit("'></head><body><h1> "), F.col("p_name"), F.lit(" </h1><div class='meta brand'>"), F.col("p_brand"),
        F.lit("</div><span class=\"price\">&yen;"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"),
        F.lit("</span><ul class='features'><li>size "), F.col("p_size").cast("string"),
        F.lit("</li><li>new</li></ul><dl><dt>Size</dt><dd>"), F.col("p_size").cast("string"), F.lit("</dd></dl></body></html>"),
    )
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice", "p_size"))
    p = part.select("p_partkey", html.alias("html"), text("https://shop.example.org/p/", F.col("p_partkey")).alias("url"))
    r = extract.extract_by_rules(ops.with_canon(p), "product")
    g = lambda k: F.get_json_object("record", f"$.{k}")
    return r.select(
        "p_partkey", g("name").alias("name"), g("brand").alias("brand"), g("price").alias("price"),
        g("description").alias("description"), g("features[0]").alias("feature"), g("specifications.Size").alias("size"),
        g("stock_status").alias("stock_status"),
    )


def paper_records(spark, sf_dir):
    """Paper pages written from the document table, read back as records."""
    safe = F.regexp_replace("text", r"[<>&\x00-\x1f\x7f]", " ")
    html = F.concat(
        F.lit("<html><head><meta name='citation_title' content='Paper "), F.col("doc_id").cast("string"),
        F.lit("'><meta name='citation_author' content='A'><meta name='citation_author' content='"), F.col("source"),
        F.lit("'><meta name='citation_publication_date' content='2024/3/"), (F.col("doc_id") % 28 + 1).cast("string"),
        F.lit("'></head><body><div class='abstract'>"), safe, F.lit("</div></body></html>"),
    )
    d = heavy(spark, sf_dir, "documents").select("doc_id", html.alias("html"), F.lit("https://p.example.org/").alias("url"))
    r = extract.extract_by_rules(ops.with_canon(d), "paper")
    g = lambda k: F.get_json_object("record", f"$.{k}")
    return r.select(
        "doc_id", g("title").alias("title"), g("authors[1]").alias("second_author"), g("published_date").alias("published_date"),
        F.length(F.regexp_replace(F.coalesce(g("abstract"), F.lit("")), r"[^a-zA-Z]", "")).alias("abstract_letters"),
    )


def detail_records(spark, sf_dir):
    p = extract.extract_by_rules(ops.with_canon(_pictured(spark, sf_dir)), "detail")
    g = lambda k: F.get_json_object("record", f"$.{k}")
    return p.select("page_id", g("title").alias("title"), g("author").alias("author"), g("images[0]").alias("first_image"), F.md5(g("description")).alias("description_md5"))


def _crawled(spark, sf_dir):
    """Whole runs over the pages: some URLs known, some missing, some runs without or with a failing extraction."""
    p = heavy(spark, sf_dir, "pages")
    i = F.col("page_id")
    both = F.explode(F.when(i % 9 == 0, F.array(F.lit(""), F.lit("/missing"))).otherwise(F.array(F.lit(""))))
    rows = p.select("page_id", "url", both.alias("suffix"))
    schema = F.when(i % 10 == 5, F.lit('{"properties":{"title":{},"price":{}},"required":["title","price"]}')).otherwise(
        F.lit('{"properties":{"title":{},"content":{}},"required":["title","content"]}')
    )
    todo = rows.select(
        text("run-", i % 10).alias("run_id"), text("task-", i % 5).alias("task_id"), (i * 2 + F.length("suffix") + 1).alias("idx"),
        F.concat("url", "suffix").alias("url"), F.lit("2024-01-02").cast("timestamp_ntz").alias("ts"), (i % 10 != 3).alias("deduplication_enabled"),
        F.when(i % 20 == 8, F.lit("div.ad")).otherwise(F.lit("")).alias("css_selector"), F.when(i % 10 == 7, F.lit("h1")).alias("content_selector"), F.lit(0.4).alias("content_filter_threshold"),
        (i % 10 != 4).alias("has_config"), F.lit("p").alias("prompt"), F.lit(True).alias("has_key"), schema.alias("output_schema"),
        (i % 4 != 1).alias("stage2_fallback_enabled"),
    )
    known = table(spark, sf_dir, "pages").where(i % 7 == 0).select("url")
    return crawl.run(todo, known, p).written()


def crawl_run(spark, sf_dir):
    """What each page of the runs gave."""
    d = _crawled(spark, sf_dir).pages
    g = lambda k: F.md5(F.get_json_object("stage2.structured_data", f"$.{k}"))
    return d.select(
        "run_id", "idx", "crawl_ok", F.col("metadata.title").alias("title"), F.md5("raw").alias("raw_md5"),
        F.col("stage2.enabled").alias("enabled"), F.col("stage2.success").alias("success"), F.col("stage2.error").alias("error"),
        g("title").alias("record_title_md5"), g("content").alias("record_content_md5"),
    )


def crawl_run_counters(spark, sf_dir):
    """The accounting of the same runs."""
    return runs.counters(_crawled(spark, sf_dir).attempts)


def crawl_run_errors(spark, sf_dir):
    """The error rows of the same runs."""
    return runs.errors(_crawled(spark, sf_dir).attempts)


def crawl_run_documents(spark, sf_dir):
    """The document rows of the same runs."""
    d = _crawled(spark, sf_dir).documents
    return d.select("id", "run_id", "source_url", "title", F.md5("content").alias("content_md5"), F.col("structured_data").isNotNull().alias("has_record"))


QUERIES = {
    f.__name__: f
    for f in (
        page_clean_text, page_raw_vs_clean, host_cleaning_stats, page_select_content, page_density_prune, page_metadata,
        page_links, host_link_stats, page_media, page_media_counts, page_stage2_input, url_canonical, page_article_records,
        page_list_records, list_items_mined, list_records_mined, page_selectors_full, list_to_detail_frontier, product_records, paper_records, detail_records, crawl_run,
        crawl_run_counters, crawl_run_errors, crawl_run_documents,
    )
}

_TITLE = q.inline(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_H1 = q.inline(r"regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
_LINKS = rf"""
tags AS (SELECT page_id, url, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (
  SELECT page_id, url, regexp_extract_all({q.without("html", "script", "style")}, '(?s)<a\s+href="[^"]*">.*?</a>') AS ts FROM pages)),
links AS (SELECT page_id, url, pos, {q.decoded("regexp_extract(t, 'href=\"([^\"]*)\"', 1)")} AS href, {q.inline("t")} AS text FROM tags),
resolved AS (SELECT *, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href ELSE href END AS absolute FROM links),
kinds AS (SELECT *, CASE WHEN absolute NOT LIKE 'http%' THEN 'other' WHEN lower(regexp_extract(absolute, '^[a-z]+://([^/?#:]*)', 1)) = """ + q.HOST + """ THEN 'internal'
  ELSE 'external' END AS kind FROM resolved)"""

# First article element with everything inside; pages cut off before its end run to the end.
_ARTICLE = r"""regexp_extract(html2, '(?s)(<article[\s>].*?)(</article>|$)', 1)"""


def _tidy(expr: str) -> str:
    full, plain = values.FULL_WIDTH, values.ASCII_FORM
    s = q.rx(expr, r"</?[a-zA-Z][^>]*>", "' '")
    s = f"translate({s}, '{full}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return f"trim({q.rx(s, r'\s+', repr(' '))})"


_BODY = _tidy(f"coalesce({q.to_text(q.without(_ARTICLE, *q.CLEAN_TAGS))}, '')")
# The pages of _rich.
_AD = """regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)"""
_RICH = rf"""rich AS (SELECT page_id, url, CASE WHEN page_id % 11 = 6
    THEN '<html><body><p><a href="/q">' || coalesce(nullif({_AD}, ''), 'q') || '</a></p></body></html>'
    ELSE replace(replace(replace(html, '<head>', '<head>' || CASE WHEN page_id % 3 = 0 THEN '<meta name="description" content="' || {_AD} || '">' ELSE '' END
      || CASE WHEN page_id % 4 = 0 THEN '<meta name="keywords" content="one, two，three">' ELSE '' END
      || CASE WHEN page_id % 5 = 0 THEN '<meta name="author" content="A. Writer">' WHEN page_id % 5 = 1 THEN '<meta property="article:published_time" content="2024-2-3">' ELSE '' END),
      '<nav><ul><li><a href="/', '<nav><ul><li><a href="' || CASE page_id % 4 WHEN 1 THEN 'https://other.example.org/' WHEN 2 THEN 'mailto:a@b.example?' ELSE '/' END),
      '<footer>', repeat('<video src="/v.mp4"></video>', page_id % 3) || repeat('<audio><source src="/a.mp3"></audio>', page_id % 2) || '<footer>') END AS html FROM pages),
"""
_meta = lambda name: q.decoded(f"""nullif(trim(regexp_extract(html, '<meta (name|property)="{name}" content="([^"]*)"', 2)), '')""")
_over_rich = lambda sql: "WITH " + _RICH + sql.removeprefix("WITH ").replace("FROM pages", "FROM rich")
_count_of = lambda tag: f"CAST((length(html) - length(replace(html, '{tag}', ''))) // {len(tag)} AS INTEGER)"
_REDUCTION = "CASE WHEN length(raw) > 0 THEN (length(raw) - length(fit)) / length(raw) END"
_VERSIONS = f"""{q.DENSE},
versions AS (
  SELECT p.page_id, p.url, {q.RAW} AS raw, d.fit AS dense_fit, {q.CLEAN} AS clean FROM pages p LEFT JOIN dense d USING (page_id)),
used AS (SELECT *, coalesce(dense_fit, CASE WHEN raw <> '' THEN clean END) AS fit FROM versions)"""
_IMAGES = r"""
imgs AS (SELECT page_id, url, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (
  SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS ts FROM pages)),
images AS (SELECT page_id, url, pos,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || """ + q.decoded("regexp_extract(t, 'href=\"([^\"]*)\"', 1)") + r""" || '.png?w=1' AS original_url,
  """ + q.decoded("regexp_extract(t, '\">([^<]*)<', 1)") + r""" AS alt_text FROM imgs)"""

# The runs of _crawled: r has a row per processed URL.
_CRAWLED = f"""WITH p AS (SELECT page_id, html, {q.without("html", "script", "style")} AS html2 FROM pages),
e AS (SELECT *, CASE WHEN page_id % 20 = 8 THEN regexp_extract(html2, '(?s)(<div class="ad">.*?</div>)', 1)
        WHEN page_id % 10 = 7 THEN regexp_extract(html2, '(?s)(<h1>.*?</h1>)', 1) ELSE {_ARTICLE} END AS part FROM p),
c AS (SELECT page_id, nullif({_TITLE}, '') AS title, {q.to_text("part")} AS raw, nullif({_tidy(f"coalesce({q.to_text(q.without('part', *q.CLEAN_TAGS))}, '')")}, '') AS body,
             coalesce(nullif({_tidy(_H1)}, ''), nullif({_TITLE}, '')) AS head FROM e),
t AS (SELECT page_id, false AS missing FROM pages WHERE page_id % 7 <> 0 OR page_id % 10 = 3
      UNION ALL SELECT page_id, true FROM pages WHERE page_id % 9 = 0),
r AS (SELECT *, page_id % 10 <> 4 AS en, page_id % 10 NOT IN (4, 5) AND NOT missing AS good FROM t JOIN c USING (page_id))
"""

_ITEMS = """WITH p AS (SELECT page_id, page_id % 3 AS kind, page_id % 9 + 1 AS d, regexp_replace(url, '[?#].*$', '') AS site, unnest(range(1, page_id % 4 + 4)) AS pos FROM pages),
items AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, 'Story ' || page_id || '-' || pos || ' of many' AS title,
  CASE kind WHEN 0 THEN regexp_extract(site, '^([a-z]+://[^/]*)', 1) || '/s/' || page_id || '-' || pos
    WHEN 1 THEN 'https://n.example.org/' || page_id || '/' || pos || '?x=1&y=2'
    ELSE regexp_extract(site, '^([a-z]+://[^/]*)', 1) || CASE WHEN ends_with(site, '/') THEN '/' || split_part(site, '/', 4) ELSE '' END || '/s/' || page_id || '-' || pos END AS url,
  'About part ' || pos || ' of ' || site AS preview, CASE WHEN kind < 2 THEN '2024-0' || d || '-15' END AS published_date FROM p)"""


def _said(t):
    return "NULL" if t is None else "'" + t.replace("{i}", "' || page_id || '").replace("{u}", "' || regexp_replace(url, '[?#].*$', '') || '") + "'"


ORACLES = {
    "list_items_mined": _ITEMS + " SELECT * FROM items",
    "list_records_mined": _ITEMS + """ SELECT page_id, CAST(count(*) AS INTEGER) AS total_count, max(title) FILTER (WHERE pos = 3) AS third_title,
  max(url) FILTER (WHERE pos = 3) AS third_url, max(preview) FILTER (WHERE pos = 1) AS first_description, max(published_date) FILTER (WHERE pos = 1) AS first_date FROM items GROUP BY page_id""",
    "page_selectors_full": "SELECT page_id, CASE page_id % " + str(len(_PICKS)) + " " + " ".join(f"WHEN {k} THEN {_said(t)}" for k, (_, t) in enumerate(_PICKS)) + """ END AS picked,
  CASE WHEN page_id % 15 <> 12 THEN page_id % 15 NOT IN (11, 13) END AS any, CASE WHEN page_id % 15 = 12 THEN 'unsupported selector: p:hover' END AS error FROM pages""",
    "page_clean_text": f"SELECT page_id, {q.CLEAN} AS clean FROM pages",
    "page_raw_vs_clean": _over_rich(f"""WITH {_VERSIONS}
SELECT page_id, CAST(length(raw) AS INTEGER) AS raw_len, CAST(length(fit) AS INTEGER) AS fit_len, md5(raw) AS raw_md5, md5(fit) AS fit_md5,
       round({_REDUCTION}, 6) AS reduction, {_REDUCTION} < 0.05 AS ineffective,
       coalesce(dense_fit, '') = '' AND raw <> '' AND clean IS NOT NULL AS fallback_used FROM used"""),
    "host_cleaning_stats": f"""WITH s AS (
  SELECT {q.HOST} AS host, coalesce(length({q.RAW}), 0) AS r, coalesce(length({q.CLEAN}), 0) AS c FROM pages)
SELECT host, count(*) AS pages, CAST(sum(r) AS BIGINT) AS raw_chars, CAST(sum(c) AS BIGINT) AS clean_chars,
       round(avg(CASE WHEN r > 0 THEN (r - c) / r END), 6) AS avg_reduction,
       count(*) FILTER (WHERE r > 0 AND (r - c) / r < 0.05) AS ineffective_pages FROM s GROUP BY host""",
    "page_select_content": f"""WITH p AS (SELECT page_id, {q.without("html", "script", "style")} AS html2 FROM pages),
e AS (SELECT page_id, html2, CASE page_id % 5
        WHEN 1 THEN regexp_extract(html2, '(?s)(<div class="ad">.*?</div>)', 1)
        WHEN 2 THEN regexp_extract(html2, '(?s)(<h1>.*?</h1>)', 1)
        WHEN 3 THEN '' ELSE {_ARTICLE} END AS element FROM p)
SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'css_selector (backward compatibility/override)'
         WHEN 2 THEN 'user-provided content_selector' WHEN 3 THEN 'user-provided content_selector'
         ELSE 'heuristic with prioritized default candidates' END AS reason,
       element <> '' AS found, {q.to_text("CASE WHEN element <> '' THEN element ELSE html2 END")} AS content FROM e""",
    "page_density_prune": f"WITH {q.DENSE} SELECT p.page_id, fit FROM pages p LEFT JOIN dense USING (page_id)",
    "page_metadata": f"""WITH {_RICH.rstrip().rstrip(",")} SELECT page_id, nullif({_TITLE}, '') AS title, {_meta("description")} AS description,
       nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language, CAST(len(regexp_split_to_array({_meta("keywords")}, '[,，]')) AS INTEGER) AS n_keywords FROM rich""".replace("CAST(len(", "CAST(coalesce(len(").replace("'[,，]'))", "'[,，]')), 0)"),
    "page_links": _over_rich(f"WITH {_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, href, text, absolute, kind FROM kinds"),
    "host_link_stats": _over_rich(f"""WITH {_LINKS} SELECT {q.HOST} AS host, count(*) AS links, count(*) FILTER (WHERE kind = 'internal') AS internal,
       count(*) FILTER (WHERE kind = 'external') AS external, count(DISTINCT absolute) AS distinct_targets FROM kinds GROUP BY 1"""),
    "page_media": f"""WITH {_IMAGES},
s AS (SELECT *, length(original_url) % 2 = 0 AND length(original_url) * 20000 <= 1048576 AS fetched,
             page_id % 5 = 0 AS downloaded, page_id % 3 <> 0 AS fallback FROM images),
t AS (SELECT *, CASE WHEN downloaded THEN 'success' WHEN NOT fallback THEN 'skipped' WHEN fetched THEN 'success' ELSE 'failed' END AS st,
             CASE WHEN downloaded THEN 'crawl4ai' WHEN fallback AND fetched THEN 'fallback' END AS m FROM s)
SELECT 'doc-' || page_id AS document_id, 'run-' || (page_id % 7) AS run_id, CAST(pos AS INTEGER) AS pos, original_url, alt_text,
       CASE WHEN st = 'success' THEN '2024-01-02/run-' || (page_id % 7) || '/images/' || regexp_extract(original_url, '([^/]*)\\?w=1$', 1) END AS minio_path,
       CASE WHEN m = 'fallback' THEN CAST(length(original_url) * 20000 AS BIGINT) END AS size_bytes,
       CASE WHEN m = 'fallback' THEN 'image/png' END AS mime_type, st AS download_status, m AS download_method FROM t""",
    "page_media_counts": f"""WITH {_RICH.rstrip().rstrip(",")} SELECT page_id, CASE WHEN page_id % 11 = 6 THEN 0 ELSE len(regexp_extract_all(html, '<li><a href="/[^"]*">[^<]*</a></li>'))
  + len(regexp_extract_all(html, '<li><a href="[hm][^"]*">[^<]*</a></li>')) END AS images, {_count_of("<video ")} AS videos, {_count_of("<source ")} AS audios FROM rich""",
    "page_stage2_input": f"""WITH {_VERSIONS},
c AS (SELECT page_id, CASE WHEN page_id % 4 = 1 THEN NULL ELSE fit END AS f, CASE WHEN page_id % 8 = 5 THEN NULL ELSE raw END AS r FROM used)
SELECT page_id, CASE WHEN f IS NOT NULL THEN 'cleaned' WHEN r IS NOT NULL THEN 'raw' ELSE 'none' END AS source,
       md5(coalesce(f, r)) AS content_md5, coalesce(f, r) IS NOT NULL AS has_html FROM c""",
    "url_canonical": f"""WITH b AS (
  SELECT page_id, url, {q.HOST} AS host, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^([^#]*)', 1) AS nofrag,
         regexp_extract(url, '^([^?#]*)', 1) AS bare, regexp_extract(url, '^([a-z]+:)', 1) AS scheme FROM pages),
d AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS dir, regexp_extract(path, '([^/]*)/*$', 1) AS last FROM b)
SELECT page_id, host, CASE WHEN last <> '' THEN last ELSE 'resource_' || substr(sha256(url), 1, 8) END AS filename,
       origin || '/a/c?x=1' AS r_root, origin || regexp_replace(dir, '[^/]*/$', '') || 'up/x.pdf' AS r_up, origin || dir || 'name' AS r_name,
       bare || '?q=2' AS r_query, nofrag || '#f' AS r_fragment, scheme || '//cdn.example.org/p' AS r_scheme,
       'https://other.example.org/z' AS r_full FROM d""",
    "page_article_records": _over_rich(f"""WITH p AS (SELECT page_id, html, {q.without("html", "script", "style")} AS html2 FROM pages)
SELECT page_id, coalesce(nullif({_tidy(_H1)}, ''), nullif({_TITLE}, '')) AS title, coalesce({_meta("author")}, 'Unknown') AS author,
       CASE WHEN {_meta("article:published_time")} IS NOT NULL THEN '2024-02-03' END AS published_date,
       nullif(CASE WHEN page_id % 11 = 6 THEN {_tidy(f"coalesce({q.to_text('html')}, '')")} ELSE {_BODY} END, '') AS content,
       CASE WHEN {_meta("keywords")} IS NULL THEN '[]' ELSE '["one","two","three"]' END AS keywords FROM p"""),
    "page_list_records": f"""WITH {_LINKS},
n AS (SELECT page_id, count(*) FILTER (WHERE text <> '' AND href <> '') AS total,
             max(absolute) FILTER (WHERE pos = 1) AS first_url, max({_tidy("text")}) FILTER (WHERE pos = 6) AS sixth_title FROM resolved GROUP BY page_id)
SELECT p.page_id, nullif({_TITLE}, '') AS page_title, CAST(coalesce(total, 0) AS INTEGER) AS total_count, first_url, sixth_title
FROM pages p LEFT JOIN n USING (page_id)""",
    "list_to_detail_frontier": f"""WITH {_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, {_tidy("text")} AS title, absolute AS detail_url FROM resolved""",
    "product_records": """SELECT p_partkey, trim(p_name) AS name, p_brand AS brand,
       '¥' || format('{:,.2f}', p_retailprice) AS price, p_type AS description, 'size ' || p_size AS feature,
       CAST(p_size AS VARCHAR) AS size, '未知' AS stock_status FROM part""",
    "paper_records": r"""SELECT doc_id, 'Paper ' || doc_id AS title, source AS second_author,
       strftime(make_date(2024, 3, CAST(doc_id % 28 + 1 AS INTEGER)), '%Y-%m-%d') AS published_date,
       CAST(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS INTEGER) AS abstract_letters FROM documents""",
    "detail_records": f"""WITH {_IMAGES},
f AS (SELECT page_id, original_url FROM images WHERE pos = 1),
p AS (SELECT page_id, html, {q.without("html", "script", "style")} AS html2 FROM pages)
SELECT page_id, coalesce(nullif({_tidy(_H1)}, ''), nullif({_TITLE}, '')) AS title, 'Unknown' AS author,
       original_url AS first_image, md5(nullif({_BODY}, '')) AS description_md5 FROM p LEFT JOIN f USING (page_id)""",
    "crawl_run": _CRAWLED + """SELECT 'run-' || (page_id % 10) AS run_id, page_id * 2 + CASE WHEN missing THEN 9 ELSE 1 END AS idx, NOT missing AS crawl_ok,
       CASE WHEN NOT missing THEN title END AS title, CASE WHEN NOT missing THEN md5(raw) END AS raw_md5, en AS enabled, good AS success,
       CASE WHEN missing THEN 'Crawl failed: No page for this URL' WHEN NOT en THEN 'No LLM config provided' WHEN good THEN NULL
            WHEN page_id % 4 = 1 THEN 'Missing required fields: price' ELSE 'Both primary and fallback extraction failed' END AS error,
       CASE WHEN good THEN md5(head) END AS record_title_md5, CASE WHEN good THEN md5(body) END AS record_content_md5 FROM r""",
    "crawl_run_counters": _CRAWLED + """SELECT 'run-' || (page_id % 10) AS run_id, count(*) FILTER (WHERE NOT missing) AS urls_crawled, count(*) FILTER (WHERE missing) AS urls_failed,
       count(*) FILTER (WHERE NOT missing) AS documents_created, count(*) FILTER (WHERE NOT missing) AS distinct_documents,
       count(*) FILTER (WHERE good) AS stage2_successes, count(*) FILTER (WHERE NOT missing AND en AND NOT good) AS stage2_errors FROM r GROUP BY 1""",
    "crawl_run_errors": _CRAWLED + """SELECT 'run-' || (page_id % 10) AS run_id, 'task-' || (page_id % 5) AS task_id, url || CASE WHEN missing THEN '/missing' ELSE '' END AS url,
       page_id * 2 + CASE WHEN missing THEN 9 ELSE 1 END AS idx, TIMESTAMP '2024-01-02' AS ts, CASE WHEN missing THEN 1 ELSE 2 END AS seq,
       CASE WHEN missing THEN 'crawl' ELSE 'stage2' END AS stage, CASE WHEN missing THEN 'No page for this URL'
         WHEN page_id % 4 = 1 THEN 'Stage 2 extraction failed: Missing required fields: price' ELSE 'Stage 2 extraction failed: Both primary and fallback extraction failed' END AS error
FROM r JOIN (SELECT page_id, url FROM pages) USING (page_id) WHERE missing OR en AND NOT good""",
    "crawl_run_documents": _CRAWLED + """SELECT substr(sha256('run-' || (page_id % 10) || '|' || url), 1, 32) AS id, 'run-' || (page_id % 10) AS run_id, url AS source_url, title,
       md5(raw) AS content_md5, good AS has_record FROM r JOIN (SELECT page_id, url FROM pages) USING (page_id) WHERE NOT missing""",
}
