"""Run accounting: counters, errors, manifest, resource index, status, cascade delete.

Input of most functions is an *attempts* table, one row per URL that a run processed:
``run_id, task_id, url, idx, ts, crawl_ok, crawl_error, stage2_enabled, stage2_success,
stage2_error, saved, exception``. ``idx`` is the URL's place in the task, URLs are processed
in that order.

A run may hold a third of all rows, so nothing collects a whole run into one group: counters
combine before the shuffle, per-run lists come in chunks of bounded size, first-n lists use
a rank limit that also runs before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import artifact_path

CHUNK = 1000
FIRST_ERRORS = 5


# --- counters and labels --------------------------------------------------------------------

def counters(attempts: DataFrame) -> DataFrame:
    """Crawled, failed and created counts per run.

    An exception after the document was saved counts as crawled and as failed.
    ``documents_created`` counts saves, ``distinct_documents`` the different URLs among them.
    """
    return attempts.groupBy("run_id").agg(
        F.count_if("crawl_ok").alias("urls_crawled"),
        (F.count_if(~F.col("crawl_ok")) + F.count_if(F.col("exception").isNotNull())).alias("urls_failed"),
        F.count_if("saved").alias("documents_created"),
        F.count_distinct(F.when(F.col("saved"), F.col("url"))).alias("distinct_documents"),
        F.count_if("stage2_success").alias("stage2_successes"),
        F.count_if(F.col("crawl_ok") & F.col("stage2_enabled") & ~F.col("stage2_success")).alias("stage2_errors"),
    )


def stage_label(documents: Column, successes: Column, failures: Column, configured: Column) -> Column:
    """Readable summary of the cleaning stages that ran."""
    # Wording of the run summary.
    first = F.when(documents > 0, F.lit("Stage 1 (crawl4ai cleaning)"))
    second = (
        F.when(successes > 0, F.concat(F.lit("Stage 2 (LLM extraction): "), successes.cast("string"), F.lit(" documents")))
        .when(configured & (failures > 0), F.concat(F.lit("Stage 2: FAILED ("), failures.cast("string"), F.lit(" errors)")))
        .when(configured, F.lit("Stage 2: ENABLED but no output"))
        .otherwise(F.lit("Stage 2: DISABLED"))
    )
    return F.concat_ws(", ", first, second)


def artifact_label(raw: Column, cleaned: Column, structured: Column) -> Column:
    """What was produced for a URL, 'none' when nothing was."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    # Artifact names.
    made = F.array_compact(
        F.array(
            F.when(has(raw), F.lit("raw markdown")),
            F.when(has(cleaned), F.lit("cleaned markdown (Stage 1)")),
            F.when(has(structured), F.lit("structured JSON (Stage 2)")),
        )
    )
    return F.when(F.size(made) > 0, F.array_join(made, ", ")).otherwise(F.lit("none"))


# --- errors ---------------------------------------------------------------------------------

def errors(attempts: DataFrame) -> DataFrame:
    """All errors of all runs: crawl failures, second-stage failures, unexpected exceptions.

    The three kinds are a union over the same rows, so they come out of one scan. Unexpected
    exceptions have a NULL stage. ``seq`` orders the errors of one URL.
    """

    def error(cond: Column, seq: int, stage: str | None, text: Column) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(seq).alias("seq"), F.lit(stage).cast("string").alias("stage"),
                F.coalesce(text, F.lit("Unknown error")).alias("error"),
            ),
        )

    ok = F.col("crawl_ok")
    kinds = F.array_compact(
        F.array(
            error(~ok, 1, "crawl", F.col("crawl_error")),
            error(
                ok & F.col("stage2_enabled") & ~F.col("stage2_success"), 2, "stage2",
                F.concat(F.lit("Stage 2 extraction failed: "), F.coalesce("stage2_error", F.lit("Unknown Stage 2 error"))),
            ),
            error(F.col("exception").isNotNull(), 3, None, F.col("exception")),
        )
    )
    return attempts.where(~ok | ~F.col("stage2_success") | F.col("exception").isNotNull()).select(
        "run_id", "task_id", "url", "idx", "ts", F.inline(kinds)
    )


SALTS = 32


def attach(rows: DataFrame, facts: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join one narrow row per key to rows of which a key may hold any share.

    The facts are repeated for a fixed number of salts, so a hot key's rows are joined in as many tasks. Rows whose
    ``spread`` is null stay and share a salt.
    """
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.coalesce(spread, F.lit(0)), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], how).drop("salt")


def error_log(error_rows: DataFrame) -> DataFrame:
    """Error log in ordered parts: part ``chunk`` holds the errors of URLs chunk*1000+1 to (chunk+1)*1000.

    A URL has at most two errors, so a part is bounded whatever the size of the run; reading the
    parts by ``chunk`` gives the run's errors in order of occurrence. Totals are attached to the
    narrow rows before they are gathered, and a run's parts are dealt to tasks one by one. Errors without a place
    are in parts of about a thousand whose ``chunk`` is null.
    """
    totals = error_rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_errors"),
        F.count_if(F.col("stage") == "crawl").alias("crawl_errors"),
        F.count_if(F.col("stage") == "stage2").alias("stage2_errors"),
        F.count_if(F.col("stage").isNull()).alias("unexpected_errors"),
        F.ceil(F.count_if(F.col("idx").isNull()) / CHUNK).alias("unplaced_parts"),
    )
    counted = ["total_errors", "crawl_errors", "stage2_errors", "unexpected_errors"]
    item = F.struct("idx", "seq", "ts", "url", "stage", "error")
    unplaced = F.when(F.col("idx").isNull(), F.xxhash64(item))
    chunked = (
        attach(error_rows, totals, "run_id", F.coalesce("idx", unplaced))
        .withColumn("chunk", F.floor((F.col("idx") - 1) / CHUNK))
        .withColumn("part", F.pmod(unplaced, "unplaced_parts"))
    )
    return (
        chunked.repartition("run_id", "chunk", "part").groupBy("run_id", "task_id", "chunk", "part", *counted)
        .agg(F.sort_array(F.collect_list(item)).alias("errors"))
        .select("run_id", "task_id", "chunk", "errors", *counted)
    )


def first_errors(error_rows: DataFrame, n: int = FIRST_ERRORS) -> DataFrame:
    """First n errors of each run in order of occurrence, ranked by ``rn``.

    The rank filter becomes a group limit before the shuffle: a task sends at most n rows per run.
    """
    w = Window.partitionBy("run_id").orderBy("idx", "seq")
    return error_rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


# --- manifest and index ---------------------------------------------------------------------

def manifest(runs: DataFrame, tasks: DataFrame, counts: DataFrame, error_rows: DataFrame) -> DataFrame:
    """One JSON manifest per run: counters, configuration, first errors.

    ``tasks`` carries the merged provider and model; runs without a task yield no manifest
    (see ``orphan_runs``). The error total follows from the counters.
    """
    summary = (
        first_errors(error_rows)
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "url", "error", "stage", "ts"))).alias("first"))
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = n("urls_failed") + n("stage2_errors")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    listed = F.transform(
        "first",
        lambda e: F.struct(e["url"].alias("url"), e["error"].alias("error"), e["stage"].alias("stage"), stamp(e["ts"]).alias("timestamp")),
    )
    body = F.struct(
        "run_id", "task_id", F.col("name").alias("task_name"), stamp(F.col("started_at")).alias("started_at"),
        n("urls_crawled").alias("urls_crawled"), n("urls_failed").alias("urls_failed"),
        n("documents_created").alias("documents_created"),
        F.struct("urls", "deduplication_enabled", "llm_provider", "llm_model").alias("configuration"),
        F.when(
            total > 0,
            F.struct(total.alias("total_errors"), F.lit(True).alias("error_log_available"), listed.alias("error_summary")),
        ).alias("errors"),
    )
    return (
        runs.select("run_id", "task_id", "started_at")
        .join(tasks, "task_id")
        .join(counts, "run_id", "left")
        .join(summary, "run_id", "left")
        .select("run_id", F.to_json(body).alias("manifest"))
    )


def orphan_runs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs whose task is gone, as error rows."""
    return runs.join(tasks, "task_id", "left_anti").select(
        "run_id", "task_id", F.concat(F.lit("Task not found: "), F.col("task_id")).alias("error")
    )


def in_chunks(rows: DataFrame, group: str, id_col: str, item: Column, size: int = CHUNK, about: DataFrame | None = None) -> DataFrame:
    """Lists of about ``size`` items per group: ``group, chunk, items`` and the columns of ``about``.

    Rows are spread over ceil(n/size) chunks by a hash of their id, or of the whole item where that is null, and chunks,
    not groups, are dealt to tasks; small groups stay in one list. Only groups of several chunks are joined to their rows by
    salts. ``about`` has one narrow row per group, which goes to its chunks beside the items; groups that it lacks are left out.
    """
    placed = rows.where(F.col(group).isNotNull())
    sizes = placed.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).alias("n_chunks"))
    h = F.coalesce(F.conv(F.substring(F.md5(F.col(id_col)), 1, 8), 16, 10).cast("bigint"), F.xxhash64(item))
    chunk = F.pmod("h", F.coalesce("n_chunks", F.lit(1))).alias("chunk")
    dealt = attach(placed.select(group, h.alias("h"), item.alias("item")), sizes.where("n_chunks > 1"), group, F.col("h"), "left").select(group, chunk, "item")
    items = F.sort_array(F.collect_list("item")).alias("items")
    if about is None:
        return dealt.repartition(group, "chunk").groupBy(group, "chunk").agg(items)
    facts = [c for c in about.columns if c != group]
    told = sizes.join(about.groupBy(*about.columns).agg(F.count(F.lit(1)).alias("times")), group).select(
        group, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1)).alias("chunk"), F.struct(F.struct(group, *facts).alias("row"), "times").alias("__told")
    )
    both = dealt.unionByName(told, allowMissingColumns=True)
    lists = both.repartition(group, "chunk").groupBy(group, "chunk").agg(items, F.collect_list("__told").alias("__told")).where(F.size("items") > 0)
    # A group that ``about`` has several times has its items as often.
    times = F.col("__told.times").cast("int")
    often = F.when(times == 1, F.col("items")).otherwise(F.flatten(F.transform("items", lambda x: F.array_repeat(x, times))))
    told_of = lists.withColumn("__told", F.explode("__told"))
    return told_of.select(group, "chunk", *(F.col("__told.row")[c].alias(c) for c in facts), often.alias("items"))


def _section(df: DataFrame, name: str, fields: Sequence[str], about: DataFrame) -> DataFrame:
    facts = [c for c in about.columns if c != "run_id"]
    return in_chunks(df, "run_id", "id", F.struct(*fields), about=about).select(
        "run_id", F.lit(name).alias("section"), "chunk", F.size("items").alias("n_items"), F.to_json("items").alias("items"), *facts
    )


def resource_index(documents: DataFrame, images: DataFrame, attachments: DataFrame, error_counts: DataFrame, run_dates: DataFrame) -> DataFrame:
    """Resources of each run in chunks: ``run_id, section, chunk, n_items, items`` (JSON), error-log path."""
    log = artifact_path(F.col("run_date"), F.col("run_id"), "logs", F.lit("error_log.json"))
    there = F.coalesce(F.col("total_errors"), F.lit(0)) > 0
    every = documents.select("run_id").distinct().join(run_dates.select("run_id", "run_date"), "run_id", "left")
    about = every.join(error_counts.select("run_id", "total_errors"), "run_id", "left").select(
        "run_id", there.alias("error_log_available"), F.when(there, log).alias("error_log_path")
    )
    res = ("id", "original_url", "minio_path", "download_status")
    return (
        _section(documents, "documents", ("id", "source_url", "title", "markdown_path", "json_path"), about)
        .unionByName(_section(run_resources(images, documents), "images", res, about))
        .unionByName(_section(run_resources(attachments, documents), "attachments", res, about))
    )


def run_resources(children: DataFrame, documents: DataFrame, run_id: str | None = None) -> DataFrame:
    """Images or attachments with the run of their document."""
    docs = documents.select(F.col("id").alias("document_id"), "run_id")
    if run_id is not None:
        docs = docs.where(F.col("run_id") == run_id)
    return children.join(docs, "document_id")


def result_bundle(runs: DataFrame, documents: DataFrame, images: DataFrame, attachments: DataFrame) -> DataFrame:
    """Everything a run produced: its own row, then documents, images and attachments in chunks."""
    known = runs.select("run_id")
    head = runs.select(
        "run_id", F.lit("run").alias("section"), F.lit(0).cast("bigint").alias("chunk"), F.lit(1).alias("n_items"),
        F.to_json(F.array(F.struct(*runs.columns))).alias("items"),
    )
    return (
        head.unionByName(_section(documents, "documents", documents.columns, known))
        .unionByName(_section(run_resources(images, documents), "images", images.columns, known))
        .unionByName(_section(run_resources(attachments, documents), "attachments", attachments.columns, known))
    )


# --- status, gaps, metrics, logs ------------------------------------------------------------

def latest_status(history: DataFrame, *, order: Sequence[str] = ("ts", "seq"), overwritten: Sequence[str] = ()) -> DataFrame:
    """Current row of each run from its append-only updates.

    ``status`` is the last one written; an ``overwritten`` column keeps its last non-null value.
    """
    rank = F.struct(*order)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), rank))
    return history.groupBy("run_id").agg(
        F.max_by("status", rank).alias("status"), *(last(c).alias(c) for c in overwritten)
    )


def gaps(runs: DataFrame, bucket: str = "hour") -> DataFrame:
    """Duration of each run and seconds since the previous run of its task.

    The previous run is found inside a (task, hour) bucket; only the first run of a bucket looks
    at the last run of the task's bucket before it. So a task with a third of all runs is spread
    over its hours, and the window over whole tasks sees one row per hour.
    """
    order = ["created_at", "run_id"]
    rows = runs.withColumn("bucket", F.date_trunc(bucket, "created_at"))
    inner = rows.withColumn(
        "prev", F.lag("created_at").over(Window.partitionBy("task_id", "bucket").orderBy(*order))
    )
    edges = (
        rows.groupBy("task_id", "bucket")
        .agg(F.max("created_at").alias("bucket_last"))
        .withColumn("before", F.lag("bucket_last").over(Window.partitionBy("task_id").orderBy("bucket")))
        .drop("bucket_last")
    )
    seconds = lambda a, b: F.timestamp_diff("SECOND", F.col(a), F.col(b))
    return (
        inner.join(edges, ["task_id", "bucket"])
        .withColumn("previous_at", F.coalesce("prev", "before"))
        .withColumn("duration_seconds", seconds("started_at", "completed_at"))
        .withColumn("gap_seconds", seconds("previous_at", "created_at"))
        .drop("prev", "before", "bucket")
    )


def operations_metrics(runs: DataFrame, *keys: str) -> DataFrame:
    """Success rate, mean duration and stored bytes."""
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("completed_at"))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.count_if(F.col("status") == "completed") / F.count(F.lit(1)), 6).alias("success_rate"),
        F.round(F.avg(seconds), 6).alias("mean_duration_seconds"),
        F.sum("size_bytes").alias("stored_bytes"),
    )


def log_locations(runs: DataFrame, error_counts: DataFrame) -> DataFrame:
    """Where the logs of a run are; runs without ``logs_path`` yield no row."""
    joined = runs.where(F.col("logs_path").isNotNull()).join(error_counts, "run_id", "left")
    has_errors = F.coalesce(F.col("total_errors"), F.lit(0)) > 0
    return joined.select(
        "run_id", "logs_path", "minio_path", "manifest_path",
        F.when(has_errors, F.concat_ws("/", "logs_path", F.lit("error_log.json"))).alias("error_log_path"),
    )


def finished_paths(run_date: Column, run_id: Column) -> dict[str, Column]:
    """Base, log and manifest path of a finished run."""
    base = F.concat_ws("/", F.date_format(run_date, "yyyy-MM-dd"), run_id)
    return {
        "minio_path": base,
        "logs_path": F.concat_ws("/", base, F.lit("logs")),
        "manifest_path": artifact_path(run_date, run_id, "logs", F.lit("run_manifest.json")),
    }


# --- cascade delete -------------------------------------------------------------------------

def cascade_delete(
    deleted: DataFrame, *, tasks: DataFrame, runs: DataFrame, documents: DataFrame, images: DataFrame,
    attachments: DataFrame, registry: DataFrame,
) -> dict[str, DataFrame]:
    """Rows that remain after deleting tasks with everything below them.

    Only key columns of the parents travel; rows without a parent stay.
    """
    gone_tasks = deleted.select("task_id").distinct()
    gone_runs = runs.join(gone_tasks, "task_id", "left_semi").select("run_id")
    gone_docs = documents.join(gone_runs, "run_id", "left_semi").select(F.col("id").alias("document_id"))
    return {
        "tasks": tasks.join(gone_tasks, "task_id", "left_anti"),
        "runs": runs.join(gone_tasks, "task_id", "left_anti"),
        "documents": documents.join(gone_runs, "run_id", "left_anti"),
        "images": images.join(gone_docs, "document_id", "left_anti"),
        "attachments": attachments.join(gone_docs, "document_id", "left_anti"),
        "registry": registry.join(gone_tasks, "task_id", "left_anti"),
    }
