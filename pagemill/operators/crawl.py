"""A whole run as one lazy plan: frontier, registry, pages, cleaning, extraction, results.

``frontier`` has one row per URL of a run: ``run_id, task_id, idx, url, ts,
deduplication_enabled, css_selector, content_selector, content_filter_threshold, has_config, prompt,
has_key, output_schema, stage2_fallback_enabled`` (see ``frontier.task_urls`` and ``tasks``). Pages
are the stored snapshot, one row per URL, with optional ``success`` and ``error`` of the fetch; a URL
without a page is a failed crawl.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import page, records
from pagemill.operators import extract, frontier as urls_ops, pages as page_ops, upsert
from pagemill.session import shared_dir

NO_PAGE = "No page for this URL"

# Columns that order the rows of one URL in a snapshot, where they are there.
_ORDER = ("ts", "fetched_at", "page_id")


@dataclass
class Run:
    """Results of ``run``; all lazy. ``pages`` feeds the others: ``written`` it is worked out once for all of them."""

    pages: DataFrame

    def written(self) -> Run:
        """The same results read back from a table in the shared folder; each view then reads the columns it needs.

        The run's filters and lists would otherwise repeat the extraction for every reference to its outcome.
        """
        spark, path = self.pages.sparkSession, shared_dir(self.pages.sparkSession, "crawl-run")
        self.pages.write.parquet(path)
        return Run(spark.read.schema(self.pages.schema).parquet(path))

    @property
    def attempts(self) -> DataFrame:
        """Rows for the accounting in ``operators.runs``."""
        return self.pages.select(
            "run_id", "task_id", "url", "idx", "ts", "crawl_ok", "crawl_error", F.col("stage2.enabled").alias("stage2_enabled"),
            F.col("stage2.success").alias("stage2_success"), F.col("stage2.error").alias("stage2_error"), F.col("crawl_ok").alias("saved"),
            F.lit(None).cast("string").alias("exception"),
        )

    @property
    def documents(self) -> DataFrame:
        """Document rows for ``upsert`` on (run_id, source_url); records only where extraction succeeded."""
        return self.pages.where("crawl_ok").select(
            document_id(F.col("run_id"), F.col("url")).alias("id"), "run_id", F.col("url").alias("source_url"),
            F.col("metadata.title").alias("title"), F.col("raw").alias("content"), "fit",
            F.col("stage2.structured_data").alias("structured_data"), F.col("metadata").alias("doc_metadata"), "ts", "idx",
        )

    @property
    def registry_rows(self) -> DataFrame:
        return upsert.registry_rows(self.pages.where("crawl_ok").select("url", "task_id", "ts"))


def document_id(run_id: Column, url: Column) -> Column:
    """The same document gets the same id when a run is repeated."""
    return F.substring(F.sha2(F.concat_ws("|", run_id, url), 256), 1, 32)


def run(frontier: DataFrame, registry: DataFrame, pages: DataFrame, kind: str = "article", second=None) -> Run:
    """Process a frontier with the rule-based extractor ``kind``.

    ``second`` maps (canon, url) to the JSON list of the fallback attempt; without it the fallback
    finds nothing. A URL that many runs share is joined by key, and Spark splits that join on skew.
    """
    todo = urls_ops.minus_registry(frontier, registry)
    # Whether a fetch worked is told without the HTML, so the search for repeated URLs reads no HTML.
    fetched = F.coalesce("success", F.lit(True)) if "success" in pages.columns else F.lit(True)
    message = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    # A snapshot may hold a URL twice: its latest row counts. Where no page id decides ties, the HTML does.
    order = F.struct(*[c for c in _ORDER if c in pages.columns], *([] if "page_id" in pages.columns else [F.xxhash64("html")]))
    facts = pages.groupBy("url").agg(F.max_by(F.struct(fetched.alias("fetched"), message.alias("fetch_error")), order).alias("p"))
    narrow = todo.join(facts.select("url", "p.*"), "url", "left").withColumn("ok", F.coalesce("fetched", F.lit(False)))
    # The HTML is shuffled once, and only joined to the rows that run.
    wanted = pages.join(todo.select("url").distinct(), "url", "left_semi")
    tried = urls_ops.processed_occurrences(narrow).join(wanted.groupBy("url").agg(F.max_by("html", order).alias("html")), "url", "left")
    limit, none = F.col("content_filter_threshold"), F.lit(None).cast("string")
    selector = page.content_selector(F.col("css_selector"), F.col("content_selector"))["selector"]
    readable = tried.withColumn("html", F.when(F.col("ok"), F.col("html")))
    marked = page_ops.text_versions(readable, limit, selector, keep_canon=True, keep_part=True)
    own = F.when(selector != page.DEFAULT_SELECTOR, F.col("part"))
    c, url = F.col("canon"), F.col("url")
    answered = (
        marked.withColumn("metadata", page.metadata(c))
        .withColumn("primary", F.when(F.col("ok"), extract.EXTRACTORS[kind](c, url, own)))
        .withColumn("fallback", none if second is None else second(c, url))
    )
    source = page_ops.stage2_input(F.col("raw"), F.col("fit"), F.col("fit_html"), F.col("html"), F.col("html"))
    crawl_error = F.when(~F.col("ok"), F.coalesce("fetch_error", F.lit(NO_PAGE)))
    outcome = records.stage2(
        has_config=F.col("has_config"), prompt=F.col("prompt"), has_key=F.col("has_key"), crawl_ok=F.col("ok"), crawl_error=crawl_error,
        primary=F.col("primary"), fallback=F.col("fallback"), fallback_enabled=F.col("stage2_fallback_enabled"),
        has_html=source["html"].isNotNull(), schema=F.col("output_schema"),
    )
    return Run(
        answered.select(
            "run_id", "task_id", "url", "idx", "ts", F.col("ok").alias("crawl_ok"), crawl_error.alias("crawl_error"), "raw", "fit", "metadata",
            outcome.alias("stage2"),
        )
    )
