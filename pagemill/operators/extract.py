"""Records from pages: rule-based extractors per record kind, and the plug for any other one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markup, page, urls, values
from pagemill.functions.binding import let
from pagemill.functions.markup import TAG, TAIL, none_if_empty

EXTRACTED = "run_id string, url string, attempt int, raw_content string, error string"

_END = r"(?=[\s/>])"


# Elements without content or end tag.
_VOID = markup.names(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def _class_pattern(tag: str, *classes: str) -> str:
    """Start tags that carry one of the classes."""
    return rf"""(?i){TAG}<(?!{_VOID}{_END}){tag}{_END}(?=[^>]*?\sclass\s*=\s*["']?(?:[^"'>]*\s)?{markup.names(classes)}["'\s/>])"""


def _by_class(c: Column, *classes: str) -> Column:
    """Whole text of the first element that carries one of the classes."""
    element = page.first_element(c, F.lit(_class_pattern("[a-z][a-z0-9]*", *classes)))
    return none_if_empty(values.tidy(markup.inline_text(element)))


def _heading(c: Column) -> Column:
    return F.coalesce(none_if_empty(values.tidy(markup.inline_text(markup.element_inner(c, "h1")))), page.title(c))


def _date(c: Column) -> Column:
    stamp = markup.attribute(F.get(markup.tags_of(c, "time"), F.lit(0)), "datetime")
    found = F.coalesce(
        page.meta_content(c, "article:published_time", "citation_publication_date", "date"), stamp, _by_class(c, "date", "published")
    )
    return values.to_iso_date(found)


def _author(c: Column) -> Column:
    found = F.coalesce(page.meta_content(c, "author", "article:author"), _by_class(c, "author", "byline"))
    return values.author_or_unknown(found, F.coalesce(page.language(c), F.lit("")))


def _body(c: Column, part: Column | None = None) -> Column:
    """Main content on one line: the given part or the default element, else the page without its skip regions."""
    chosen = F.coalesce(*([] if part is None else [part]), page.select_default(c), c)
    return none_if_empty(values.tidy(F.coalesce(markup.to_text(markup.drop_regions(chosen)), F.lit(""))))


def _items_of(c: Column, container: str) -> Column:
    """Whole texts of the outermost li elements of the first list with a class; an inner list belongs to its item."""
    whole = page.inside(page.first_element(c, F.lit(_class_pattern("(?:ul|ol)", container))))
    pieces = F.split(whole, rf"(?i)(?={TAG}</?(?:ul|ol|li){_END})")
    starts = lambda p, tags: F.rlike(p, F.lit(rf"(?i)^{TAG}<{tags}{_END}"))
    ends = lambda p, tags: F.rlike(p, F.lit(rf"(?i)^{TAG}</{tags}{_END}"))

    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + F.when(starts(p, "(?:ul|ol)"), 1).when(ends(p, "(?:ul|ol)"), -1).otherwise(0)
        first = starts(p, "li") & (acc["depth"] == 0)
        return F.struct(depth.alias("depth"), F.concat(acc["marks"], F.when(first, F.lit("1")).otherwise(F.lit("0"))).alias("marks"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("marks"))

    def texts(ps: Column) -> Column:
        # One digit a piece, so that the fold carries little; then pieces between two marks are one item.
        marked = F.array_join(F.zip_with(ps, F.split(F.aggregate(ps, start, step)["marks"], ""), lambda p, m: F.concat(F.when(m == "1", F.lit(markup.MID)).otherwise(F.lit("")), F.coalesce(p, F.lit("")))), "")
        items = F.slice(F.split(marked, markup.MID), F.lit(2), F.greatest(F.size(F.split(marked, markup.MID)) - 1, F.lit(0)))
        return F.filter(F.transform(items, lambda i: markup.inline_text(i)), lambda t: t != "")

    return let(pieces, texts)


def _pairs(c: Column) -> Column:
    """Every dt with the dds up to the next dt as a map; several dds are comma-joined, of a repeated name the last stays."""
    pieces = F.split(c, rf"(?i)(?={TAG}</?(?:dt|dd|dl){_END})")
    cells = F.filter(pieces, lambda p: F.rlike(p, F.lit(rf"(?i)^{TAG}<(?:dt|dd){_END}")))
    said = F.transform(cells, lambda p: F.struct(F.rlike(p, F.lit(rf"(?i)^{TAG}<dt{_END}")).alias("name"), markup.inline_text(p).alias("text")))

    def step(acc: Column, x: Column) -> Column:
        named = F.struct(F.map_concat(F.map_filter(acc["m"], lambda k, _: k != x["text"]), F.create_map(x["text"], F.lit(""))).alias("m"), x["text"].alias("k"), F.lit(0).alias("n"))
        longer = F.when(acc["n"] == 0, x["text"]).otherwise(F.concat_ws(", ", F.element_at(acc["m"], acc["k"]), x["text"]))
        valued = F.struct(
            F.map_concat(F.map_filter(acc["m"], lambda k, _: k != acc["k"]), F.create_map(acc["k"], longer)).alias("m"), acc["k"].alias("k"), (acc["n"] + 1).alias("n")
        )
        return F.when(x["name"], named).when(acc["k"].isNull(), acc).otherwise(valued)

    start = F.struct(F.map_from_arrays(F.array(), F.array()).cast("map<string,string>").alias("m"), F.lit(None).cast("string").alias("k"), F.lit(0).alias("n"))
    return let(said, lambda s: F.map_filter(F.aggregate(s, start, step)["m"], lambda _, v: v != ""))


def article(c: Column, url: Column, part: Column | None = None) -> Column:
    return F.to_json(
        F.struct(
            _heading(c).alias("title"), _author(c).alias("author"), _date(c).alias("published_date"),
            _body(c, part).alias("content"), page.keywords(c).alias("keywords"),
        )
    )


def list_page(c: Column, url: Column, part: Column | None = None) -> Column:
    items = F.transform(
        F.filter(page.anchors(c if part is None else F.coalesce(part, c)), lambda a: (a["text"] != "") & (a["href"] != "")),
        lambda a: F.struct(values.tidy(a["text"]).alias("title"), urls.resolve(url, a["href"]).alias("url")),
    )
    return let(
        items,
        lambda i: F.to_json(F.struct(page.title(c).alias("page_title"), i.alias("items"), F.size(i).alias("total_count"))),
    )


def product(c: Column, url: Column, part: Column | None = None) -> Column:
    price = F.coalesce(_by_class(c, "price"), page.meta_content(c, "product:price:amount"))
    return F.to_json(
        F.struct(
            _heading(c).alias("name"), _by_class(c, "brand").alias("brand"), values.price_text(price).alias("price"),
            F.coalesce(page.meta_content(c, "description", "og:description"), _by_class(c, "description")).alias("description"),
            _items_of(c, "features").alias("features"), _pairs(c).alias("specifications"),
            F.coalesce(_by_class(c, "stock", "availability"), F.lit("未知")).alias("stock_status"),
        )
    )


def paper(c: Column, url: Column, part: Column | None = None) -> Column:
    authors = F.filter(
        F.transform(
            F.filter(markup.tags_of(c, "meta"), lambda t: F.lower(markup.attribute(t, "name", False)) == "citation_author"),
            lambda t: markup.attribute(t, "content"),
        ),
        lambda a: a != "",
    )
    return F.to_json(
        F.struct(
            F.coalesce(page.meta_content(c, "citation_title"), _heading(c)).alias("title"), authors.alias("authors"),
            F.coalesce(_by_class(c, "abstract"), page.meta_content(c, "citation_abstract")).alias("abstract"),
            _date(c).alias("published_date"), page.meta_content(c, "citation_journal_title").alias("journal"),
            page.meta_content(c, "citation_doi").alias("doi"), page.keywords(c).alias("keywords"),
        )
    )


def detail(c: Column, url: Column, part: Column | None = None) -> Column:
    pictures = F.transform(
        F.filter(page.images(c), lambda i: F.coalesce(i["src"], F.lit("")) != ""), lambda i: urls.resolve(url, i["src"])
    )
    return F.to_json(
        F.struct(
            _heading(c).alias("title"), values.price_text(_by_class(c, "price")).alias("price"),
            _body(c, part).alias("description"), _pairs(c).alias("specifications"), _date(c).alias("published_date"),
            _author(c).alias("author"), pictures.alias("images"),
        )
    )


# Of a page and its URL; a part that a task selected takes the place of the default main content.
EXTRACTORS: dict[str, Callable[..., Column]] = {
    "article": article, "list_page": list_page, "product": product, "paper": paper, "detail": detail,
}


def extract_by_rules(pages: DataFrame, kind: str) -> DataFrame:
    """Add ``record`` (JSON) of one record kind; needs ``canon`` and ``url``."""
    return pages.withColumn("record", EXTRACTORS[kind](F.col("canon"), F.col("url")))


def extract_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], attempt: int = 1) -> DataFrame:
    """Run a batch extractor over (run_id, url, content, prompt, schema).

    ``fn`` takes one Arrow batch as a pandas frame and returns ``raw_content`` and ``error`` per
    row, in order. If it raises, the batch is halved until the rows that fail stand alone; those become
    error rows, never a failed job. So few rows are handed over twice.
    """

    def run(batch: pd.DataFrame) -> tuple[list, list]:
        out = fn(batch)
        if len(out) != len(batch):
            raise ValueError("extractor must return one row per input row")
        return list(out["raw_content"]), list(out["error"])

    def halved(batch: pd.DataFrame) -> tuple[list, list]:
        try:
            return run(batch)
        except Exception as ex:  # noqa: BLE001 - user code, reported per row
            if len(batch) == 1:
                return [None], [str(ex)]
            middle = len(batch) // 2
            first, second = halved(batch.iloc[:middle]), halved(batch.iloc[middle:])
            return first[0] + second[0], first[1] + second[1]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            raw, err = halved(batch) if len(batch) else ([], [])
            yield pd.DataFrame(
                {"run_id": batch["run_id"], "url": batch["url"], "attempt": attempt, "raw_content": raw, "error": err}
            )

    return df.select("run_id", "url", "content", "prompt", "schema").mapInPandas(batches, EXTRACTED)


def with_attempts(pages: DataFrame, outputs: DataFrame, order: str | None = None) -> DataFrame:
    """Join pages to the answers of the first and second attempt (``primary``, ``fallback``) by run and URL.

    Answers are folded to one row per page first, so the join sees unique keys. ``order`` names the column that tells
    which of several answers to one attempt is the last; without it, answers that differ count as none.
    """

    def of(n: int) -> Column:
        raw = F.when(F.col("attempt") == n, F.col("raw_content"))
        if order is not None:
            return F.max_by(raw, F.when(raw.isNotNull(), F.col(order)))
        return F.when(F.min(raw) == F.max(raw), F.max(raw))

    answers = outputs.groupBy("run_id", "url").agg(of(1).alias("primary"), of(2).alias("fallback"))
    return pages.join(answers, ["run_id", "url"], "left")
