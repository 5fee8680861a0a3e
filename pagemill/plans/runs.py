"""Queries over run accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import metrics, runs as ops
from pagemill.plans import inputs
from pagemill.plans.inputs import table, text, with_views
from pagemill.session import shared_dir


def run_counters(spark, sf_dir):
    return ops.counters(inputs.attempts(spark, sf_dir))


def run_stage_summary(spark, sf_dir):
    """What each run says about its stages; some runs fetch no page, some extract no record."""
    n = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int")
    a = inputs.attempts(spark, sf_dir).withColumns({
        "crawl_ok": F.col("crawl_ok") & (n % 10 != 0), "saved": F.col("saved") & (n % 10 != 0), "stage2_success": F.col("stage2_success") & (n % 5 != 0),
    })
    configured = a.groupBy("run_id").agg(F.bool_or("stage2_enabled").alias("configured"))
    c = ops.counters(a).join(configured, "run_id")
    return c.select("run_id", ops.stage_label(F.col("documents_created"), F.col("stage2_successes"), F.col("stage2_errors"), F.col("configured")).alias("summary"))


def run_errors(spark, sf_dir):
    return ops.errors(inputs.attempts(spark, sf_dir))


def run_error_log(spark, sf_dir):
    log = ops.error_log(ops.errors(inputs.attempts(spark, sf_dir)))
    return log.withColumn(
        "errors", F.array_join(F.transform("errors", lambda e: F.concat_ws("|", e["idx"].cast("string"), F.coalesce(e["stage"], F.lit("-")), e["error"])), "\n")
    )


def run_first_errors(spark, sf_dir):
    e = ops.first_errors(ops.errors(inputs.attempts(spark, sf_dir)))
    return e.select("run_id", "rn", "url", "stage", "error", "ts")


def run_manifest(spark, sf_dir):
    a = inputs.attempts(spark, sf_dir)
    m = ops.manifest(inputs.event_runs(spark, sf_dir), inputs.event_tasks(spark, sf_dir), ops.counters(a), ops.errors(a))
    g = lambda p: F.get_json_object("manifest", f"$.{p}")
    return m.select(
        "run_id", g("task_name").alias("task_name"), g("started_at").alias("started_at"), g("urls_crawled").cast("bigint").alias("urls_crawled"),
        g("urls_failed").cast("bigint").alias("urls_failed"), g("documents_created").cast("bigint").alias("documents_created"),
        g("configuration.urls[0]").alias("first_url"), g("configuration.llm_provider").alias("llm_provider"),
        g("errors.total_errors").cast("bigint").alias("total_errors"), g("errors.error_summary[0].error").alias("first_error"),
        g("errors.error_summary[4].url").alias("fifth_error_url"),
    )


def run_orphans(spark, sf_dir):
    """Runs whose task was removed."""
    tasks = inputs.event_tasks(spark, sf_dir).where(F.regexp_extract("task_id", "([0-9]+)$", 1).cast("int") % 4 != 1)
    return ops.orphan_runs(inputs.event_runs(spark, sf_dir), tasks)


def run_images(spark, sf_dir):
    return ops.run_resources(inputs.shop_images(spark, sf_dir), inputs.shop_documents(spark, sf_dir))


def run_attachments(spark, sf_dir):
    return ops.run_resources(inputs.shop_attachments(spark, sf_dir), inputs.shop_documents(spark, sf_dir))


def run_resource_index(spark, sf_dir):
    """Resource index of every run, with one hot run that holds a third of the documents."""
    hot = F.when(F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 3 == 0, F.lit("run-0")).otherwise(F.col("run_id"))
    docs = inputs.shop_documents(spark, sf_dir).withColumn("run_id", hot)
    n = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int")
    every = inputs.shop_runs(spark, sf_dir).select("run_id")
    errors = every.where(n % 2 == 0).withColumn("total_errors", F.lit(1))
    dates = every.withColumn("run_date", F.date_add(F.lit("2024-01-01").cast("date"), n % 30))
    return ops.resource_index(docs, inputs.shop_images(spark, sf_dir), inputs.shop_attachments(spark, sf_dir), errors, dates)


def run_result_bundle(spark, sf_dir):
    return ops.result_bundle(
        inputs.shop_runs(spark, sf_dir), inputs.shop_documents(spark, sf_dir),
        inputs.shop_images(spark, sf_dir), inputs.shop_attachments(spark, sf_dir),
    )


def run_artifact_labels(spark, sf_dir):
    """What each attempt produced and where its artifacts go."""
    a = inputs.attempts(spark, sf_dir)
    raw = F.when(F.col("saved"), F.lit("text"))
    clean = F.when(F.col("saved") & (F.col("idx") % 3 != 0), F.lit("text"))
    record = F.when(F.col("stage2_success"), F.lit("{}"))
    doc = F.md5(F.concat_ws("|", "run_id", "url"))
    path = lambda kind, name, cond: F.when(cond, ops.artifact_path(F.col("ts").cast("date"), F.col("run_id"), kind, name))
    return a.select(
        "run_id", "idx", ops.artifact_label(raw, clean, record).alias("artifacts"),
        path("markdown", F.concat(doc, F.lit(".md")), raw.isNotNull()).alias("markdown_path"),
        path("markdown", F.concat(doc, F.lit("_cleaned.md")), clean.isNotNull()).alias("cleaned_path"),
        path("json", F.concat(doc, F.lit(".json")), record.isNotNull()).alias("json_path"),
    )


def run_log_paths(spark, sf_dir):
    r = inputs.event_runs(spark, sf_dir)
    p = ops.finished_paths(F.col("run_date"), F.col("run_id"))
    n = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int")
    logged = r.select(
        "run_id", p["minio_path"].alias("minio_path"), p["manifest_path"].alias("manifest_path"),
        F.when(n % 4 != 0, p["logs_path"]).alias("logs_path"),
    )
    counts = ops.errors(inputs.attempts(spark, sf_dir)).groupBy("run_id").agg(F.count(F.lit(1)).alias("total_errors"))
    return ops.log_locations(logged, counts)


def run_latest_status(spark, sf_dir):
    """Current state of each run from its status updates; later updates overwrite what they set."""
    e = table(spark, sf_dir, "events")
    history = e.select(
        text("run-", F.col("user_id")).alias("run_id"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", F.lit("pending")).when(F.col("event_type") == "click", F.lit("running"))
        .when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.when(F.col("event_type") == "error", text("value ", F.col("event_id"))).alias("error_message"),
        F.when(F.col("event_type") == "purchase", F.col("ts")).alias("completed_at"),
    )
    return ops.latest_status(history, overwritten=("error_message", "completed_at"))


def _order_runs(spark, sf_dir):
    k = F.col("o_orderkey")
    minutes = lambda n: F.make_dt_interval(mins=n.cast("int"))
    # A third of the runs belong to one task.
    task = F.when(k % 3 == 0, F.lit("task-hot")).otherwise(text("task-", F.col("o_custkey") % 50))
    return table(spark, sf_dir, "orders").select(
        text("run-", F.lpad(k.cast("string"), 12, "0")).alias("run_id"), task.alias("task_id"),
        (F.col("o_orderdate") + minutes(k % 1440)).alias("created_at"), (F.col("o_orderdate") + minutes(k % 1440 + 1)).alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + minutes(k % 1440 + 1 + k % 60)).alias("completed_at"),
        F.when(F.col("o_orderstatus") == "F", F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.col("o_totalprice").cast("bigint").alias("size_bytes"),
    )


_ORDER_RUNS = """order_runs AS (
  SELECT 'run-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'task-hot' ELSE 'task-' || (o_custkey % 50) END AS task_id,
         o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS created_at,
         o_orderdate + to_minutes(CAST(o_orderkey % 1440 + 1 AS INTEGER)) AS started_at,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(CAST(o_orderkey % 1440 + 1 + o_orderkey % 60 AS INTEGER)) END AS completed_at,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status, CAST(trunc(o_totalprice) AS BIGINT) AS size_bytes
  FROM orders)"""


def run_gaps(spark, sf_dir):
    g = ops.gaps(_order_runs(spark, sf_dir))
    return g.select("run_id", "task_id", "previous_at", "duration_seconds", "gap_seconds")


def run_operations_metrics(spark, sf_dir):
    return ops.operations_metrics(_order_runs(spark, sf_dir), "task_id")


def attempt_metrics(spark, sf_dir):
    """Counts, distinct URLs and quantiles of durations of each task over two weeks, merged from what two batches stored per day."""
    e = table(spark, sf_dir, "events")
    attempts = e.select(
        "event_id", F.col("ts").cast("date").alias("run_date"), text("task-", F.col("user_id") % 20).alias("task_id"),
        text("https://e.example.org/", F.col("user_id"), "/", F.col("event_type")).alias("url"), (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") != "click", F.floor(F.col("value") * 1000)).alias("duration"),
    )
    base = shared_dir(spark, "metrics")
    for batch in (0, 1):
        metrics.write_metrics(attempts.where(F.col("event_id") % 2 == batch), base, batch)
    return metrics.over_period(spark, base, "2024-01-08", "2024-01-21")


QUERIES = {
    f.__name__: f
    for f in (
        attempt_metrics, run_counters, run_stage_summary, run_errors, run_error_log, run_first_errors, run_manifest, run_orphans, run_images, run_attachments,
        run_resource_index, run_result_bundle, run_artifact_labels, run_log_paths, run_latest_status, run_gaps, run_operations_metrics,
    )
}

_ATT = with_views(inputs.ATTEMPTS)
_ERR = with_views(inputs.ATTEMPTS, inputs.ERRORS)
_SHOP = with_views(inputs.SHOP_RUNS, inputs.SHOP_DOCUMENTS, inputs.SHOP_IMAGES, inputs.SHOP_ATTACHMENTS)
_N = "CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER)"


def _chunked(src: str, section: str, fields: str) -> str:
    """Chunk lists of one section, in the notation of the query."""
    struct = ", ".join(f"'{f}': {f}" for f in fields.split())
    order = ", ".join(f"{f} NULLS FIRST" for f in fields.split())
    return f"""SELECT run_id, '{section}' AS section, chunk, CAST(count(*) AS INTEGER) AS n_items,
  '[' || string_agg(CAST(json_merge_patch('{{}}', to_json({{{struct}}})) AS VARCHAR), ',' ORDER BY {order}) || ']' AS items
FROM (SELECT *, CAST(('0x' || substr(md5(id), 1, 8)) AS BIGINT) % CAST(ceil(count(*) OVER (PARTITION BY run_id) / 1000.0) AS BIGINT) AS chunk FROM {src})
GROUP BY run_id, chunk"""


_CLASS = "CASE WHEN d < 128 THEN d ELSE s * 128 + (d >> s) END"
_MIDDLE = "CASE WHEN {0} < 128 THEN {0} ELSE (({0} % 128) << CAST({0} // 128 AS INTEGER)) + ((1::BIGINT << CAST({0} // 128 AS INTEGER)) >> 1) END"
_RANK = "min(CASE WHEN upto * 100 >= total * {0} THEN b END) AS b{0}"

ORACLES = {
    "attempt_metrics": f"""WITH a AS (SELECT 'task-' || (user_id % 20) AS task_id, user_id || '/' || event_type AS url, event_type <> 'error' AS ok,
  CASE WHEN event_type <> 'click' THEN CAST(floor(value * 1000) AS BIGINT) END AS d FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'),
c AS (SELECT task_id, {_CLASS} AS b FROM (SELECT task_id, d, greatest(length(bin(d)) - 7, 0) AS s FROM a WHERE d IS NOT NULL)),
r AS (SELECT task_id, b, row_number() OVER (PARTITION BY task_id ORDER BY b) AS upto, count(*) OVER (PARTITION BY task_id) AS total FROM c),
q AS (SELECT task_id, {", ".join(_RANK.format(p) for p in (50, 90, 99))} FROM r GROUP BY task_id)
SELECT task_id, count(*) AS attempts, count(*) FILTER (WHERE ok) AS succeeded, count(DISTINCT url) AS distinct_urls,
  {", ".join(f"any_value({_MIDDLE.format(f'b{p}')}) AS p{p}" for p in (50, 90, 99))}
FROM a LEFT JOIN q USING (task_id) GROUP BY task_id""",
    "run_counters": _ATT + """SELECT run_id, count(*) FILTER (WHERE crawl_ok) AS urls_crawled,
       count(*) FILTER (WHERE NOT crawl_ok) + count(exception) AS urls_failed, count(*) FILTER (WHERE saved) AS documents_created,
       count(DISTINCT CASE WHEN saved THEN url END) AS distinct_documents, count(*) FILTER (WHERE stage2_success) AS stage2_successes,
       count(*) FILTER (WHERE crawl_ok AND stage2_enabled AND NOT stage2_success) AS stage2_errors FROM attempts GROUP BY run_id""",
    "run_stage_summary": _ATT + f""", a AS (SELECT * REPLACE (crawl_ok AND {_N} % 10 <> 0 AS crawl_ok, saved AND {_N} % 10 <> 0 AS saved,
  stage2_success AND {_N} % 5 <> 0 AS stage2_success) FROM attempts)
SELECT run_id, concat_ws(', ', CASE WHEN docs > 0 THEN 'Stage 1 (crawl4ai cleaning)' END,
       CASE WHEN s2 > 0 THEN 'Stage 2 (LLM extraction): ' || s2 || ' documents'
            WHEN configured AND f2 > 0 THEN 'Stage 2: FAILED (' || f2 || ' errors)'
            WHEN configured THEN 'Stage 2: ENABLED but no output' ELSE 'Stage 2: DISABLED' END) AS summary
FROM (SELECT run_id, count(*) FILTER (WHERE saved) AS docs, count(*) FILTER (WHERE stage2_success) AS s2,
             count(*) FILTER (WHERE crawl_ok AND stage2_enabled AND NOT stage2_success) AS f2, bool_or(stage2_enabled) AS configured
      FROM a GROUP BY run_id)""",
    "run_errors": _ERR + "SELECT run_id, task_id, url, idx, ts, seq, stage, error FROM errors",
    "run_error_log": _ERR + """, totals AS (SELECT run_id, count(*) AS total_errors, count(*) FILTER (WHERE stage = 'crawl') AS crawl_errors,
    count(*) FILTER (WHERE stage = 'stage2') AS stage2_errors, count(*) FILTER (WHERE stage IS NULL) AS unexpected_errors FROM errors GROUP BY run_id)
SELECT e.run_id, task_id, (idx - 1) // 1000 AS chunk,
       string_agg(idx || '|' || coalesce(stage, '-') || '|' || error, chr(10) ORDER BY idx, seq) AS errors,
       any_value(total_errors) AS total_errors, any_value(crawl_errors) AS crawl_errors, any_value(stage2_errors) AS stage2_errors,
       any_value(unexpected_errors) AS unexpected_errors
FROM errors e JOIN totals USING (run_id) GROUP BY e.run_id, task_id, chunk""",
    "run_first_errors": _ERR + """SELECT run_id, CAST(rn AS INTEGER) AS rn, url, stage, error, ts FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY idx, seq) AS rn FROM errors) WHERE rn <= 5""",
    "run_manifest": with_views(inputs.ATTEMPTS, inputs.ERRORS, inputs.EVENT_RUNS) + """,
c AS (SELECT run_id, count(*) FILTER (WHERE crawl_ok) AS crawled, count(*) FILTER (WHERE NOT crawl_ok) + count(exception) AS failed,
             count(*) FILTER (WHERE saved) AS created FROM attempts GROUP BY run_id),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY idx, seq) AS rn FROM errors),
s AS (SELECT run_id, count(*) AS total, max(error) FILTER (WHERE rn = 1) AS e1, max(url) FILTER (WHERE rn = 5) AS u5 FROM f GROUP BY run_id)
SELECT r.run_id, 'Task ' || task_id AS task_name, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS started_at, crawled AS urls_crawled, failed AS urls_failed,
       created AS documents_created, 'https://' || task_id || '.example.org/' AS first_url,
       CASE WHEN CAST(substr(task_id, 6) AS INTEGER) % 5 <> 0 THEN 'openai' END AS llm_provider, total AS total_errors, e1 AS first_error, u5 AS fifth_error_url
FROM event_runs r JOIN c USING (run_id) LEFT JOIN s USING (run_id)""",
    "run_orphans": with_views(inputs.ATTEMPTS, inputs.EVENT_RUNS) + """SELECT run_id, task_id, 'Task not found: ' || task_id AS error
FROM event_runs WHERE CAST(substr(task_id, 6) AS INTEGER) % 4 = 1""",
    "run_images": _SHOP + "SELECT i.*, d.run_id FROM shop_images i JOIN shop_documents d ON i.document_id = d.id",
    "run_attachments": _SHOP + "SELECT i.*, d.run_id FROM shop_attachments i JOIN shop_documents d ON i.document_id = d.id",
    "run_resource_index": _SHOP + f""",
hot AS (SELECT * REPLACE (CASE WHEN CAST(substr(id, 5) AS BIGINT) % 3 = 0 THEN 'run-0' ELSE run_id END AS run_id) FROM shop_documents),
ri AS (SELECT i.*, d.run_id FROM shop_images i JOIN hot d ON i.document_id = d.id),
ra AS (SELECT i.*, d.run_id FROM shop_attachments i JOIN hot d ON i.document_id = d.id),
parts AS ({_chunked("hot", "documents", "id source_url title markdown_path json_path")}
UNION ALL {_chunked("ri", "images", "id original_url minio_path download_status")}
UNION ALL {_chunked("ra", "attachments", "id original_url minio_path download_status")})
SELECT *, {_N} % 2 = 0 AS error_log_available, CASE WHEN {_N} % 2 = 0 THEN
  strftime(DATE '2024-01-01' + {_N} % 30, '%Y-%m-%d') || '/' || run_id || '/logs/error_log.json' END AS error_log_path FROM parts""",
    "run_result_bundle": _SHOP + f""",
ri AS (SELECT i.*, d.run_id FROM shop_images i JOIN shop_documents d ON i.document_id = d.id),
ra AS (SELECT i.*, d.run_id FROM shop_attachments i JOIN shop_documents d ON i.document_id = d.id),
parts AS ({_chunked("shop_documents", "documents", "id run_id source_url title markdown_path json_path")}
UNION ALL {_chunked("ri", "images", "id document_id original_url minio_path download_status")}
UNION ALL {_chunked("ra", "attachments", "id document_id original_url minio_path download_status")})
SELECT * FROM parts WHERE run_id IN (SELECT run_id FROM shop_runs)
UNION ALL SELECT run_id, 'run', 0, 1, '[' || CAST(json_merge_patch('{{}}', to_json({{'run_id': run_id, 'task_id': task_id, 'status': status, 'logs_path': logs_path}})) AS VARCHAR) || ']' FROM shop_runs""",
    "run_artifact_labels": _ATT + """SELECT run_id, idx, CASE WHEN NOT saved THEN 'none' ELSE concat_ws(', ', 'raw markdown',
         CASE WHEN idx % 3 <> 0 THEN 'cleaned markdown (Stage 1)' END, CASE WHEN stage2_success THEN 'structured JSON (Stage 2)' END) END AS artifacts,
       CASE WHEN saved THEN p || 'markdown/' || h || '.md' END AS markdown_path,
       CASE WHEN saved AND idx % 3 <> 0 THEN p || 'markdown/' || h || '_cleaned.md' END AS cleaned_path,
       CASE WHEN stage2_success THEN p || 'json/' || h || '.json' END AS json_path
FROM (SELECT *, strftime(ts, '%Y-%m-%d') || '/' || run_id || '/' AS p, md5(run_id || '|' || url) AS h FROM attempts)""",
    "run_log_paths": with_views(inputs.ATTEMPTS, inputs.ERRORS, inputs.EVENT_RUNS) + f"""
SELECT run_id, b || '/logs' AS logs_path, b AS minio_path, b || '/logs/run_manifest.json' AS manifest_path,
       CASE WHEN run_id IN (SELECT run_id FROM errors) THEN b || '/logs/error_log.json' END AS error_log_path
FROM (SELECT run_id, strftime(run_date, '%Y-%m-%d') || '/' || run_id AS b, {_N} AS n FROM event_runs) WHERE n % 4 <> 0""",
    "run_latest_status": """WITH h AS (SELECT 'run-' || user_id AS run_id, ts, event_id,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN event_type = 'error' THEN 'value ' || event_id END AS m, CASE WHEN event_type = 'purchase' THEN ts END AS c FROM events)
SELECT run_id, max_by(status, (ts, event_id)) AS status, max_by(m, (ts, event_id)) FILTER (WHERE m IS NOT NULL) AS error_message,
       max_by(c, (ts, event_id)) FILTER (WHERE c IS NOT NULL) AS completed_at FROM h GROUP BY run_id""",
    "run_gaps": with_views(_ORDER_RUNS) + """SELECT run_id, task_id, previous_at, date_diff('second', started_at, completed_at) AS duration_seconds,
       date_diff('second', previous_at, created_at) AS gap_seconds
FROM (SELECT *, lag(created_at) OVER (PARTITION BY task_id ORDER BY created_at, run_id) AS previous_at FROM order_runs)""",
    "run_operations_metrics": with_views(_ORDER_RUNS) + """SELECT task_id, count(*) AS runs,
       round(count(*) FILTER (WHERE status = 'completed') / count(*), 6) AS success_rate,
       round(avg(date_diff('second', started_at, completed_at)), 6) AS mean_duration_seconds, CAST(sum(size_bytes) AS BIGINT) AS stored_bytes
FROM order_runs GROUP BY task_id""",
}
