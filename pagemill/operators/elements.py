"""Elements of pages by full selectors, and the records of list pages; both need ``canon`` (see ``pages.with_canon``).

Pages go to Python a hundred rows at a time, not in Arrow batches of ten thousand: the work on a page outweighs its way
there, and what a worker holds doesn't grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markup, outline, page, urls, values
from pagemill.session import ship

_FOUND = "struct<html:string,n:int,error:string>"


def _mined(canon: str | None) -> list[dict] | None:
    return None if canon is None else outline.mined(outline.Outline(canon))


def _select(canon: str | None, selector: str | None) -> dict | None:
    if canon is None or selector is None:
        return None
    try:
        o = outline.Outline(canon)
        found = outline.select(o, selector)
    except outline.Unsupported as e:
        return {"html": None, "n": None, "error": f"unsupported selector: {e}"}
    return {"html": o.outer(found[0]) if found else None, "n": len(found), "error": None}


def select(pages: DataFrame, selector: Column, name: str = "selected") -> DataFrame:
    """Add struct<html, n, error>: the first selected element (in normal form), how many there are, and what went wrong.

    Of a comma list the first member that selects anything counts. Tags, ``.class``, ``#id``, attributes with all operators,
    ``:first-child``, ``:last-child``, ``:only-child``, ``:empty``, ``:nth-child``, ``:not``, and the four combinators; a
    selector with anything else gives an error, not a guess. Null pages and selectors give null.
    """
    ship(pages.sparkSession)
    return pages.withColumn(name, F.udf(_select, _FOUND, useArrow=False)(F.col("canon"), selector))


def text_of(selected: Column) -> Column:
    """Text of a selected element on one line; null without one."""
    return markup.inline_text(selected["html"])


def list_items(pages: DataFrame, *keys: str) -> DataFrame:
    """One row per record of a page's main list: ``keys``, pos (1-based), title, url (absolute), preview, published_date.

    Null pages and pages without a list give no row.
    """
    ship(pages.sparkSession)

    items = F.udf(_mined, "array<struct<title:string,href:string,preview:string,date:string>>", useArrow=False)
    day_first = F.regexp_replace("x.date", r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$", "$3-$2-$1")
    rows = pages.select(*keys, F.col("url").alias("__page"), F.posexplode(items(F.col("canon"))).alias("i", "x"))
    return rows.select(
        *keys, (F.col("i") + 1).alias("pos"), F.col("x.title").alias("title"), urls.resolve(F.col("__page"), F.col("x.href")).alias("url"),
        F.col("x.preview").alias("preview"), values.to_iso_date(day_first).alias("published_date"),
    )


def list_records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, record``: one JSON record per page with its title, items in page order and their count; pages without a list included."""
    heads = pages.select(key, "canon", "url", page.title(F.col("canon")).alias("page_title"))
    item = F.struct("pos", "title", "url", F.col("preview").alias("description"), F.col("published_date").alias("date"))
    lists = list_items(heads, key, "page_title").groupBy(key, "page_title").agg(F.sort_array(F.collect_list(item)).alias("items"))  # one page's items
    bare = F.transform("items", lambda x: x.dropFields("pos"))
    return heads.select(key, "page_title").join(lists.drop("page_title"), key, "left").select(
        key, F.to_json(F.struct("page_title", F.coalesce(bare, F.array()).alias("items"), F.coalesce(F.size("items"), F.lit(0)).alias("total_count"))).alias("record")
    )
