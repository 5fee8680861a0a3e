"""From tasks to URLs to crawl: validation, fan-out, deduplication, list-to-detail hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.values import to_date

MAX_NAME = 255


def validation_errors(name: Column, url_list: Column) -> Column:
    """Reasons why a task is rejected; empty for a valid one."""
    bad = F.filter(url_list, lambda u: ~F.coalesce(urls.is_http(u), F.lit(False)))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.length(name), F.lit(0)) < 1, F.lit("name is empty")),
            F.when(F.length(name) > MAX_NAME, F.lit("name is longer than 255")),
            F.when(F.coalesce(F.size(url_list), F.lit(0)) < 1, F.lit("At least one URL is required")),
            F.when(F.size(bad) > 0, F.concat(F.lit("Invalid URL format: "), F.get(bad, F.lit(0)))),
        )
    )


def validated(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into valid tasks and a quarantine table with ``reasons``."""
    checked = tasks.withColumn("reasons", validation_errors(F.col("name"), F.col("urls")))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def task_urls(tasks: DataFrame, *carry: str) -> DataFrame:
    """One row per URL of a task with its 1-based place ``idx``."""
    return tasks.select("task_id", *carry, F.posexplode("urls").alias("i", "url")).select(
        "task_id", *carry, (F.col("i") + 1).alias("idx"), "url"
    )


def minus_registry(frontier: DataFrame, registry: DataFrame) -> DataFrame:
    """Drop URLs that the global registry knows, for tasks with ``deduplication_enabled``.

    One anti-join: for a task without deduplication the probe carries a prefix that no URL has,
    so it matches nothing and still spreads over all partitions (NULL probes would pile up).
    """
    dedup = F.coalesce(F.col("deduplication_enabled"), F.lit(True))
    probe = F.when(dedup, F.col("url")).otherwise(F.concat(F.lit("any:"), F.col("url")))
    known = registry.select(F.col("url").alias("known_url"))
    return frontier.withColumn("probe", probe).join(known, F.col("probe") == F.col("known_url"), "left_anti").drop("probe")


#: Places of a run in a row that share one row of the first successes.
PLACES = 1000


def processed_occurrences(attempts: DataFrame) -> DataFrame:
    """Attempts that really run when a URL repeats inside a run.

    With ``deduplication_enabled`` a URL is tried until its first success and later occurrences are
    skipped; without it every occurrence runs. The first success per URL comes from an aggregate
    with partial combine, by stretches of ``PLACES`` places, so a URL that fills a third of the run is no
    single-task window and its rows are joined in as many tasks as it has stretches. There are never more stretches
    than attempts, and they are merged, not broadcast: their number grows with the attempts, which a size that is
    estimated from compressed files doesn't show.
    """
    keys = ["run_id", "url", "stretch"]
    placed = attempts.withColumn("stretch", F.floor(F.col("idx") / PLACES))
    done = F.min(F.when(F.col("ok") & F.col("deduplication_enabled"), F.col("idx")))
    first_ok = placed.groupBy(*keys).agg(done.alias("done")).select(*keys, F.min("done").over(Window.partitionBy("run_id", "url")).alias("first_ok"))
    return (
        placed.join(first_ok.where("first_ok is not null").hint("merge"), keys, "left")
        .where(~F.col("deduplication_enabled") | F.col("first_ok").isNull() | (F.col("idx") <= F.col("first_ok")))
        .drop("first_ok", "stretch")
    )


def items_frontier(records: DataFrame) -> DataFrame:
    """Detail-page URLs of list records: (page_id, url, structured_data) to (page_id, pos, title, detail_url).

    Items keep their page order in ``pos``; relative URLs become absolute, other schemes are dropped.
    """
    items = F.from_json(F.get_json_object("structured_data", "$.items"), "array<struct<title:string,url:string>>")
    rows = records.select("page_id", F.col("url").alias("list_url"), F.posexplode(items).alias("i", "item"))
    hop = rows.select(
        "page_id", (F.col("i") + 1).alias("pos"), F.col("item.title").alias("title"),
        urls.resolve(F.col("list_url"), F.col("item.url")).alias("detail_url"),
    )
    return hop.where(urls.is_http(F.col("detail_url")))


def published_after(records: DataFrame, date_col: str, after: Column, keep_unknown: bool = True) -> DataFrame:
    """Keep content published after the task's date; without a date in the task everything stays."""
    published = to_date(F.col(date_col))
    unknown = published.isNull() if keep_unknown else F.lit(False)
    return records.where(after.isNull() | F.coalesce(published.cast("timestamp_ntz") > after, F.lit(False)) | unknown)
