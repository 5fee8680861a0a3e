"""Page tables: both text versions, cleaning effect, second-stage input, links, media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markup, page, urls
from pagemill.functions.markup import none_if_empty

# Fixed value: a reduction below this share counts as ineffective cleaning.
INEFFECTIVE_BELOW = 0.05


def with_canon(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by its normal form ``canon``; tokenised once, read by everything after."""
    return pages.withColumn("canon", markup.canon(F.col("html")))


def needs_fallback(raw: Column, fit: Column) -> Column:
    """There is text, but no cleaned version of it."""
    return (F.length(F.coalesce(raw, F.lit(""))) > 0) & (F.coalesce(fit, F.lit("")) == "")


def text_versions(
    pages: DataFrame, threshold: Column | None = None, selector: Column | None = None, keep_canon: bool = False, keep_part: bool = False
) -> DataFrame:
    """Add ``raw``, ``fit``, ``fit_html`` and ``fallback_used``; on request ``canon`` of the whole page and of the selected part.

    ``fit`` is the dense text; where pruning leaves nothing, the region-free text stands in. With a
    selector both versions come from the selected element, or the whole page if there is none.
    """
    limit = F.lit(None).cast("double") if threshold is None else threshold
    c = F.col("canon")
    part = c if selector is None else F.coalesce(page.select_content(c, selector), c)
    staged = (
        with_canon(pages)
        .withColumn("part", part)
        .withColumn("raw", markup.to_text(F.col("part")))
        .withColumn("dense", page.dense_versions(F.col("part"), limit))
    )
    use = needs_fallback(F.col("raw"), F.col("dense.fit"))
    return (
        staged.withColumn("fallback", F.when(use, markup.to_text(markup.drop_regions(F.col("part")))))
        .withColumn("fit", F.coalesce(F.col("dense.fit"), F.col("fallback")))
        .withColumn("fit_html", F.col("dense.fit_html"))
        .withColumn("fallback_used", F.col("fallback").isNotNull())
        .drop("dense", "fallback", *([] if keep_part else ["part"]), *([] if keep_canon else ["canon"]))
    )


def given_versions(plain: Column, raw: Column, fit: Column, fit_html: Column) -> Column:
    """struct<raw, fit, fit_html> of text made elsewhere: a plain text serves as both versions."""
    none = F.lit(None).cast("string")
    return F.when(
        plain.isNotNull(), F.struct(plain.alias("raw"), plain.alias("fit"), none.alias("fit_html"))
    ).otherwise(F.struct(raw.alias("raw"), fit.alias("fit"), fit_html.alias("fit_html")))


def single_text(plain: Column, raw: Column, fit: Column) -> Column:
    """The one text of a page: plain, else full, else cleaned."""
    return F.coalesce(plain, raw, fit)


def reduction(raw: Column, fit: Column) -> Column:
    """Share of characters that cleaning removed; NULL without raw text, may be negative."""
    n = F.length(raw)
    return F.when(n > 0, (n - F.length(fit)) / n)


def ineffective(raw: Column, fit: Column) -> Column:
    return reduction(raw, fit) < INEFFECTIVE_BELOW


def cleaning_stats(df: DataFrame, *keys: str) -> DataFrame:
    """Sizes before and after cleaning per key; needs ``raw_len`` and ``clean_len``."""
    r = F.when(F.col("raw_len") > 0, (F.col("raw_len") - F.col("clean_len")) / F.col("raw_len"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("raw_len").alias("raw_chars"),
        F.sum("clean_len").alias("clean_chars"),
        F.round(F.avg(r), 6).alias("avg_reduction"),
        F.count_if(r < INEFFECTIVE_BELOW).alias("ineffective_pages"),
    )


def stage2_input(raw: Column, fit: Column, fit_html: Column, cleaned_html: Column, html: Column) -> Column:
    """struct<source, content, html>: cleaned text if not blank, else raw text, else nothing."""
    blank = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(markup.WS_CHARS)) == ""
    pick = lambda a, b: F.coalesce(none_if_empty(a), none_if_empty(b))
    none = F.lit(None).cast("string")
    return (
        F.when(~blank(fit), F.struct(F.lit("cleaned").alias("source"), fit.alias("content"), pick(fit_html, cleaned_html).alias("html")))
        .when(~blank(raw), F.struct(F.lit("raw").alias("source"), raw.alias("content"), pick(html, cleaned_html).alias("html")))
        .otherwise(F.struct(F.lit("none").alias("source"), none.alias("content"), none.alias("html")))
    )


def links(pages: DataFrame) -> DataFrame:
    """One row per anchor: page_id, url, pos (1-based), href, text, absolute, kind."""
    exploded = with_canon(pages).select("page_id", "url", F.posexplode(page.anchors(F.col("canon"))).alias("i", "a"))
    resolved = exploded.select(
        "page_id", "url", (F.col("i") + 1).alias("pos"), F.col("a.href").alias("href"), F.col("a.text").alias("text"),
        urls.resolve(F.col("url"), F.col("a.href")).alias("absolute"),
    )
    return resolved.withColumn("kind", page.link_kind(F.col("url"), F.col("absolute")))


def attachments(link_rows: DataFrame) -> DataFrame:
    """Links whose path ends in a document extension."""
    return link_rows.where(urls.extension(F.col("absolute")).isin(*urls.ATTACHMENT_EXTENSIONS)).withColumn(
        "filename", urls.filename(F.col("absolute"))
    )


def media_counts(pages: DataFrame) -> DataFrame:
    c = F.col("canon")
    return with_canon(pages).select(
        "page_id", "url",
        F.size(page.images(c)).alias("images"),
        F.size(page.videos(c)).alias("videos"),
        F.size(page.audios(c)).alias("audios"),
    )


def images(pages: DataFrame) -> DataFrame:
    """One row per image with a source: page_id, url, pos, original_url (absolute), alt_text."""
    found = with_canon(pages).select("page_id", "url", F.posexplode(page.images(F.col("canon"))).alias("i", "m"))
    return found.where(F.coalesce(F.col("m.src"), F.lit("")) != "").select(
        "page_id", "url", (F.col("i") + 1).alias("pos"),
        urls.resolve(F.col("url"), F.col("m.src")).alias("original_url"), F.col("m.alt").alias("alt_text"),
    )
