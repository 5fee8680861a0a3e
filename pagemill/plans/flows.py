"""Queries that go through files or streams: import and export, snapshots, sinks, streaming jobs, plug-in extractor."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from pagemill.functions import markup
from pagemill.operators import extract, frontier, tasks as task_ops, upsert
from pagemill.operators import runs as run_ops
from pagemill.plans import inputs, pages as page_plans, sqltext as q
from pagemill.plans.inputs import heavy, spread, table, text
from pagemill.session import shared_dir
from pagemill.sources import readers, schemas, tables
from pagemill.streaming import jobs


def _definitions(spark, sf_dir):
    k = F.col("c_custkey")
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).select(
        F.col("c_name").alias("name"), F.when(k % 3 == 0, F.lit("描述: 1")).alias("description"),
        F.array(text("https://a.example.org/", k), text("https://b.example.org/", k)).alias("urls"),
        F.create_map(F.lit("api_key"), F.lit("hidden"), F.lit("temperature"), F.lit("0.2")).alias("llm_params"),
        F.col("c_mktsegment").alias("llm_model"), (k % 2 == 0).alias("deduplication_enabled"),
        F.when(k % 5 == 0, F.lit("2024-03-01T00:00:00")).alias("only_after_date"), (k % 20).cast("int").alias("fallback_max_size_mb"),
    )


def _imported(rows):
    return rows.where(F.col("parse_error").isNull()).select(
        "name", "description", F.element_at("urls", 2).alias("second_url"), F.size("llm_params").alias("n_params"), "llm_model",
        "deduplication_enabled", "only_after_date", "fallback_max_size_mb", F.col("crawl_config.verbose").alias("verbose"),
        F.size(frontier.validation_errors(F.col("name"), F.col("urls"))).alias("n_errors"),
    )


def task_export_import(spark, sf_dir):
    """Export all tasks as JSON lines without keys, read them back and validate."""
    d = _definitions(spark, sf_dir)
    out = shared_dir(spark, "tasks-json")
    tables.export_tasks(d.select(task_ops.export_json(d).alias("task")), out, "json")
    return _imported(readers.parse_tasks(spark.read.text(out), "value"))


def task_yaml_round_trip(spark, sf_dir):
    """Tasks to YAML text and back."""
    d = _definitions(spark, sf_dir)
    y = d.select(readers.json_to_yaml(task_ops.export_json(d)).alias("yaml"))
    return _imported(readers.parse_tasks(y.select(readers.yaml_to_json(F.col("yaml")).alias("value")), "value"))


def registry_snapshots(spark, sf_dir):
    """Registry in versions: the first half of the month, then the merge of the second half."""
    crawls = table(spark, sf_dir, "events").select(
        text("https://e.example.org/", F.col("user_id")).alias("url"), F.col("event_type").alias("task_id"), "ts"
    )
    base = shared_dir(spark, "registry")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    tables.write_version(upsert.registry_rows(crawls.where(F.col("ts") < cut)), base, 1)
    merged = upsert.merge_registry(tables.read_current(spark, base), upsert.registry_rows(crawls.where(F.col("ts") >= cut)))
    tables.write_version(merged, base, 2)
    return tables.read_current(spark, base)


def artifact_sink(spark, sf_dir):
    """Cleaned pages written by run and kind, then listed from the written folders."""
    from pagemill.operators.pages import text_versions

    p = heavy(spark, sf_dir, "pages")
    docs = text_versions(p).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 3).cast("int")).alias("run_date"),
        text("run-", F.col("page_id") % 5).alias("run_id"), F.col("page_id").alias("id"), "raw", "fit",
        F.when(F.col("page_id") % 4 == 0, F.lit("{}")).otherwise(text('{"id":', F.col("page_id"), "}")).alias("structured_data"),
        (F.col("page_id") % 7 != 0).alias("success"),
    )
    base = shared_dir(spark, "artifacts")
    tables.write_artifacts(docs, base)
    return spark.read.parquet(base).groupBy("run_date", "run_id", "kind").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("chars")
    )


def blob_index(spark, sf_dir):
    """Pages stored as media files, some of them made large; which pass a limit of one megabyte, with size and type."""
    out = shared_dir(spark, "media")
    times = F.when(F.col("page_id") % 50 == 7, F.lit(400)).otherwise(F.lit(1))
    # Making a file costs more than its bytes, so pages are dealt to tasks.
    dealt = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    tables.write_files(dealt.select("page_id", F.col("html").alias("value"), times.alias("times")), out, "page_id")
    b = readers.blobs(spark, out, max_size_mb=1)
    return b.select(F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id"), "length", "mime_type")


def library_read(spark, sf_dir):
    """A template per nation, written as text files and read back as a library."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.concat_ws("\n", F.lit("Suppliers:"), F.array_sort(F.collect_list("s_name"))).alias("value")
    )
    out = shared_dir(spark, "library")
    rows.write.partitionBy("n_name").text(out)
    return readers.library(spark, out).select("dir", F.md5(F.rtrim("content", F.lit("\n"))).alias("content_md5"))


def run_logs_written(spark, sf_dir):
    """Manifests, counters and error logs of all runs, packed in few files and counted from them."""
    a = inputs.attempts(spark, sf_dir)
    runs = inputs.event_runs(spark, sf_dir)
    dates = runs.select("run_id", "run_date")
    manifests = run_ops.manifest(runs, inputs.event_tasks(spark, sf_dir), run_ops.counters(a), run_ops.errors(a)).join(dates, "run_id")
    index = run_ops.counters(a).join(dates, "run_id").select("run_id", "run_date", "documents_created")
    log = run_ops.error_log(run_ops.errors(a)).join(dates, "run_id").select("run_id", "run_date", "chunk", F.size("errors").alias("n"))
    out = shared_dir(spark, "run-logs")
    tables.pack_run_logs(manifests, index, log, out)
    inside = lambda path: F.get_json_object("content", path).cast("bigint")
    n = F.when(F.col("kind") == "run_manifest", F.lit(1)).when(F.col("kind") == "resource_index", inside("$.documents_created")).otherwise(inside("$.n"))
    return tables.read_packed(spark, out).groupBy("kind", "run_date", "run_id").agg(F.sum(n.cast("bigint")).alias("n"))


def run_artifact_index(spark, sf_dir):
    """Error texts of all attempts packed in two batches by date, and what the index of files says about each run."""
    e = run_ops.errors(inputs.attempts(spark, sf_dir)).select(
        F.col("ts").cast("date").alias("run_date"), "run_id", F.coalesce("stage", F.lit("other")).alias("kind"), F.col("error").alias("content")
    )
    out, cut = shared_dir(spark, "packed"), F.lit("2024-01-15").cast("date")
    tables.write_packed(e.where(F.col("run_date") < cut), out, 0)
    tables.write_packed(e.where(F.col("run_date") >= cut), out, 1)
    return tables.packed_index(spark, out).groupBy("run_date", "run_id", "kind", "batch").agg(F.sum("n").alias("n"))


def resource_view(spark, sf_dir):
    """The listing of images: its columns only, of a table that has more."""
    none = F.lit(None).cast("string")
    wide = inputs.shop_images(spark, sf_dir).select(
        "*", none.alias("alt_text"), F.length("original_url").cast("bigint").alias("size_bytes"), F.lit("image/png").alias("mime_type"),
        none.alias("download_method"), F.lit("2024-01-02").cast("timestamp_ntz").alias("created_at"), F.lit("x").alias("internal_note"),
    )
    return schemas.view(wide, "image")


def pluggable_extractor(spark, sf_dir):
    """A user function over batches of cleaned text; rows it refuses become error rows."""
    p = heavy(spark, sf_dir, "pages").select(
        text("run-", F.col("page_id") % 5).alias("run_id"), "url", markup.clean_text(F.col("html")).alias("content"),
        F.when(F.col("page_id") % 50 == 7, F.lit("refuse")).otherwise(F.lit("count")).alias("prompt"), F.lit(None).cast("string").alias("schema"),
    )

    def count_chars(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["prompt"] == "refuse").any():
            raise ValueError("refused")
        return pd.DataFrame({"raw_content": [json.dumps({"chars": len(c or "")}) for c in batch["content"]], "error": None})

    return extract.extract_with(p, count_chars)


def stream_page_ingest(spark, sf_dir):
    pages = readers.page_stream(spark, f"{sf_dir}/pages.parquet")
    out = shared_dir(spark, "ingest")
    jobs.run_available(jobs.ingest(pages, spark.sparkContext.defaultParallelism), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").select("page_id", F.md5("raw").alias("raw_md5"), F.md5("fit").alias("fit_md5"))


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(schemas.EVENTS).parquet(readers.stream_path(f"{sf_dir}/events.parquet"))


def stream_registry(spark, sf_dir):
    crawls = _event_stream(spark, sf_dir).select(
        text("https://e.example.org/", F.col("user_id")).alias("url"), F.col("event_type").alias("task_id"), "ts"
    )
    out = shared_dir(spark, "registry-stream")
    jobs.registry_deltas(crawls, f"{out}/data", f"{out}/checkpoint")
    return jobs.read_registry(spark, f"{out}/data")


def stream_dedup(spark, sf_dir):
    urls = _event_stream(spark, sf_dir).select(
        text("https://e.example.org/", F.col("user_id"), "/", F.col("event_type")).alias("url"), F.col("ts").cast("timestamp").alias("ts")
    )
    out = shared_dir(spark, "dedup")
    jobs.run_available(jobs.dedup_bounded(urls, "url", "ts", "60 days").select("url"), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data")


def stream_dedup_exact(spark, sf_dir):
    """Events as frontier rows in several micro-batches, against a registry of the users that purchased."""
    out = shared_dir(spark, "dedup-exact")
    table(spark, sf_dir, "events").select("event_id", "user_id").repartition(4, "event_id").write.parquet(f"{out}/events")
    rows = spark.readStream.schema("event_id bigint, user_id bigint").option("maxFilesPerTrigger", 1).parquet(f"{out}/events").select(
        F.col("event_id").alias("seq"), text("https://e.example.org/", F.col("user_id")).alias("url"),
        (F.col("user_id") % 4 != 0).alias("deduplication_enabled"),
    )
    known = lambda: table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("value") > 100)).select(
        text("https://e.example.org/", F.col("user_id")).alias("url")
    )
    jobs.dedup_exact(rows, known, f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").groupBy("url", "deduplication_enabled").agg(F.count(F.lit(1)).alias("n"))


def stream_dedup_keyed(spark, sf_dir):
    """The same frontier rows against the same registry, in eight files and two sittings, with the URLs seen as keyed state."""
    out = shared_dir(spark, "dedup-keyed")
    inbox, e = f"{out}/inbox", table(spark, sf_dir, "events")
    run = lambda: jobs.dedup_keyed(spark, inbox, f"{out}/data", f"{out}/checkpoint", partitions=8, files=1)
    rows = e.select(F.col("event_id").alias("seq"), text("https://e.example.org/", F.col("user_id")).alias("url"), (F.col("user_id") % 4 != 0).alias("deduplication_enabled"))
    bought = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    jobs.known_urls(e.where(bought).select(text("https://e.example.org/", F.col("user_id")).alias("url")).coalesce(1), inbox)
    run()
    for part in (0, 1):
        jobs.new_urls(rows.where(F.col("seq") % 2 == part).repartition(4, "seq"), inbox)
        run()
    return spark.read.parquet(f"{out}/data").groupBy("url", "deduplication_enabled").agg(F.count(F.lit(1)).alias("n"))


def stream_run_ends(spark, sf_dir):
    """A run per event, started at its time, in four sittings a week each; some ends never come, some too late, some after a week."""
    k, out = F.col("event_id"), shared_dir(spark, "run-ends")
    # Seconds are cut so that no row lies between a watermark's milliseconds.
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts")).withColumn(
        "week", F.least(F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01")) / 7), F.lit(3))
    )
    starts = e.select("week", text("run-", k).alias("run_id"), text("task-", F.col("user_id") % 20).alias("task_id"), F.col("ts").alias("started_at"))
    ends = e.where(k % 7 != 0).select(
        F.when(k % 11 == 5, F.col("week") + 2).otherwise(F.col("week")).alias("week"), text("run-", k).alias("run_id"),
        F.timestamp_add("MINUTE", k % 100, F.col("ts")).alias("completed_at"), F.when(k % 5 == 0, F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
    )
    for week in range(4):
        starts.where(F.col("week") == week).drop("week").write.mode("append").parquet(f"{out}/starts")
        ends.where(F.col("week") == week).drop("week").write.mode("append").parquet(f"{out}/ends")
        jobs.watch_runs(spark, f"{out}/starts", f"{out}/ends", f"{out}/data", f"{out}/checkpoint", "60 MINUTES", "2 hours", 8)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.parquet(f"{out}/data").select("run_id", "task_id", ntz("started_at"), ntz("completed_at"), "status", "error")


def stream_run_monitor(spark, sf_dir):
    e = _event_stream(spark, sf_dir).select("ts", (F.col("event_type") != "error").alias("crawl_ok"))
    out = shared_dir(spark, "monitor")
    jobs.monitor_updates(jobs.monitor(e), f"{out}/data", f"{out}/checkpoint")
    return jobs.read_monitor(spark, f"{out}/data").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = {
    f.__name__: f
    for f in (
        task_export_import, task_yaml_round_trip, registry_snapshots, artifact_sink, blob_index, library_read, run_logs_written, run_artifact_index, resource_view,
        pluggable_extractor, stream_page_ingest,
        stream_registry, stream_dedup, stream_dedup_exact, stream_dedup_keyed, stream_run_ends, stream_run_monitor,
    )
}

_TASKS = """SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '描述: 1' END AS description,
  'https://b.example.org/' || c_custkey AS second_url, 1 AS n_params, c_mktsegment AS llm_model, c_custkey % 2 = 0 AS deduplication_enabled,
  CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END AS only_after_date, CAST(c_custkey % 20 AS INTEGER) AS fallback_max_size_mb,
  true AS verbose, 0 AS n_errors FROM customer"""
_REGISTRY = """SELECT 'https://e.example.org/' || user_id AS url, max_by(event_type, (ts, event_type)) AS task_id, min(ts) AS first_crawled_at,
  max(ts) AS last_crawled_at, count(*) AS crawl_count FROM events GROUP BY user_id"""

# One row for each new URL; every row of a task without deduplication.
_NEW_URLS = """SELECT 'https://e.example.org/' || user_id AS url, user_id % 4 <> 0 AS deduplication_enabled,
  CASE WHEN user_id % 4 <> 0 THEN 1 ELSE count(*) END AS n FROM events
WHERE user_id % 4 = 0 OR user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100) GROUP BY user_id"""

ORACLES = {
    "task_export_import": _TASKS,
    "task_yaml_round_trip": _TASKS,
    "registry_snapshots": _REGISTRY,
    "artifact_sink": f"""WITH {page_plans._VERSIONS},
d AS (SELECT DATE '2024-01-01' + CAST(page_id % 3 AS INTEGER) AS run_date, 'run-' || (page_id % 5) AS run_id, * FROM used)
SELECT run_date, run_id, 'markdown' AS kind, count(*) AS files, CAST(sum(length(raw)) AS BIGINT) AS chars FROM d WHERE raw <> '' GROUP BY 1, 2
UNION ALL SELECT run_date, run_id, 'markdown_cleaned', count(*), CAST(sum(length(fit)) AS BIGINT) FROM d WHERE fit <> '' GROUP BY 1, 2
UNION ALL SELECT run_date, run_id, 'json', count(*), CAST(sum(length('{{"id":' || page_id || '}}')) AS BIGINT) FROM d
  WHERE page_id % 4 <> 0 AND page_id % 7 <> 0 GROUP BY 1, 2""",
    "pluggable_extractor": f"""SELECT 'run-' || (page_id % 5) AS run_id, url, 1 AS attempt,
  CASE WHEN page_id % 50 <> 7 THEN '{{"chars": ' || coalesce(length({q.CLEAN}), 0) || '}}' END AS raw_content,
  CASE WHEN page_id % 50 = 7 THEN 'refused' END AS error FROM pages""",
    "stream_page_ingest": f"WITH {page_plans._VERSIONS} SELECT page_id, md5(raw) AS raw_md5, md5(fit) AS fit_md5 FROM used",
    "stream_registry": _REGISTRY,
    "stream_dedup": "SELECT DISTINCT 'https://e.example.org/' || user_id || '/' || event_type AS url FROM events",
    "blob_index": """SELECT page_id, n AS length, 'text/plain' AS mime_type
FROM (SELECT page_id, CAST(strlen(html) * CASE WHEN page_id % 50 = 7 THEN 400 ELSE 1 END + 1 AS BIGINT) AS n FROM pages) WHERE n <= 1048576""",
    "library_read": """SELECT 'n_name=' || n_name AS dir, md5('Suppliers:' || chr(10) || string_agg(s_name, chr(10) ORDER BY s_name)) AS content_md5
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    "run_logs_written": inputs.with_views(inputs.ATTEMPTS, inputs.ERRORS, inputs.EVENT_RUNS) + """
SELECT 'run_manifest' AS kind, run_date, run_id, CAST(1 AS BIGINT) AS n FROM event_runs
UNION ALL SELECT 'resource_index', run_date, run_id, count(*) FILTER (WHERE saved) FROM event_runs JOIN attempts USING (run_id) GROUP BY run_date, run_id
UNION ALL SELECT 'error_log', run_date, run_id, count(*) FROM event_runs JOIN errors USING (run_id) GROUP BY run_date, run_id""",
    "run_artifact_index": inputs.with_views(inputs.ATTEMPTS, inputs.ERRORS) + """
SELECT CAST(ts AS DATE) AS run_date, run_id, coalesce(stage, 'other') AS kind, CAST(ts >= TIMESTAMP '2024-01-15' AS INTEGER) AS batch, CAST(count(*) AS BIGINT) AS n
FROM errors GROUP BY ALL""",
    "resource_view": inputs.with_views(inputs.SHOP_IMAGES) + """SELECT id, document_id, original_url, minio_path, CAST(NULL AS VARCHAR) AS alt_text,
  CAST(length(original_url) AS BIGINT) AS size_bytes, 'image/png' AS mime_type, download_status, CAST(NULL AS VARCHAR) AS download_method,
  TIMESTAMP '2024-01-02' AS created_at FROM shop_images""",
    "stream_dedup_exact": _NEW_URLS,
    "stream_dedup_keyed": _NEW_URLS,
    # An end counts if it comes with its week's rows and in time; without one the row shows once the watermark has passed.
    "stream_run_ends": """WITH e AS (SELECT event_id, 'run-' || event_id AS run_id, 'task-' || (user_id % 20) AS task_id,
  date_trunc('second', ts) AS started_at, least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7, 3) AS week FROM events),
ends AS (SELECT event_id, started_at + to_minutes(event_id % 100) AS completed_at, CASE WHEN event_id % 11 = 5 THEN week + 2 ELSE week END AS week,
  week AS home FROM e WHERE event_id % 7 <> 0),
mark AS (SELECT least((SELECT max(started_at) FROM e), (SELECT max(completed_at) FROM ends WHERE week <= 3)) - INTERVAL 2 HOUR AS w),
j AS (SELECT e.*, x.completed_at FROM e LEFT JOIN ends x
  ON x.event_id = e.event_id AND x.completed_at <= started_at + INTERVAL 60 MINUTE AND x.week = x.home)
SELECT run_id, task_id, started_at, completed_at,
  CASE WHEN completed_at IS NULL THEN 'error' WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN completed_at IS NULL THEN 'no end within 60 MINUTES' END AS error
FROM j, mark WHERE completed_at IS NOT NULL OR started_at + INTERVAL 60 MINUTE < w""",
    "stream_run_monitor": """SELECT date_trunc('hour', ts) AS window_start, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status,
  count(*) AS n FROM events GROUP BY 1, 2""",
}
