"""Crawl-shaped inputs that Spark derives from the given tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts whose rows get costly work. The scan's own partitions are used: nothing is shuffled for it."""
    return table(spark, sf_dir, name)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows that get costly work, dealt to tasks evenly or by keys.

    A compact table is one or two splits however many rows it has, so its scan would leave the work to as many cores. A
    number of partitions that is given isn't coalesced by bytes: the rows are small and the work on them isn't.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def text(*parts):
    """Concatenate literals (str) and columns (Column) to a string column."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed URLs: a run per user, an attempt per event."""
    e = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    enabled = F.col("user_id") % 3 != 0
    failed2 = F.col("event_type") == "signup"
    return e.select(
        text("run-", F.col("user_id")).alias("run_id"),
        text("task-", F.col("user_id") % 20).alias("task_id"),
        text("https://site", F.col("event_id") % 97, ".example.org/p/", F.col("event_id")).alias("url"),
        (F.col("event_id") + 1).alias("idx"),
        "ts",
        ok.alias("crawl_ok"),
        F.when(~ok, text("HTTP ", F.get_json_object("props", "$.k"))).alias("crawl_error"),
        enabled.alias("stage2_enabled"),
        (ok & enabled & ~failed2).alias("stage2_success"),
        F.when(enabled & failed2, F.lit("LLM returned empty/no extracted_content")).alias("stage2_error"),
        ok.alias("saved"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 100), F.lit("disk full")).alias("exception"),
    )


ATTEMPTS = """attempts AS (
  SELECT 'run-' || user_id AS run_id, 'task-' || (user_id % 20) AS task_id,
         'https://site' || (event_id % 97) || '.example.org/p/' || event_id AS url, event_id + 1 AS idx, ts,
         event_type <> 'error' AS crawl_ok,
         CASE WHEN event_type = 'error' THEN 'HTTP ' || json_extract_string(props, '$.k') END AS crawl_error,
         user_id % 3 <> 0 AS stage2_enabled,
         event_type NOT IN ('error', 'signup') AND user_id % 3 <> 0 AS stage2_success,
         CASE WHEN event_type = 'signup' AND user_id % 3 <> 0
              THEN 'LLM returned empty/no extracted_content' END AS stage2_error,
         event_type <> 'error' AS saved,
         CASE WHEN event_type = 'purchase' AND value > 100 THEN 'disk full' END AS exception
  FROM events)"""

ERRORS = """errors AS (
  SELECT run_id, task_id, url, idx, ts, 1 AS seq, 'crawl' AS stage, crawl_error AS error FROM attempts WHERE NOT crawl_ok
  UNION ALL
  SELECT run_id, task_id, url, idx, ts, 2, 'stage2', 'Stage 2 extraction failed: ' || stage2_error
  FROM attempts WHERE crawl_ok AND stage2_enabled AND NOT stage2_success
  UNION ALL
  SELECT run_id, task_id, url, idx, ts, 3, NULL, exception FROM attempts WHERE exception IS NOT NULL)"""


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the attempts table: start and end from the run's first and last attempt."""
    return (
        attempts(spark, sf_dir)
        .groupBy("run_id", "task_id")
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"))
        .withColumn("run_date", F.col("started_at").cast("date"))
    )


EVENT_RUNS = """event_runs AS (
  SELECT run_id, task_id, min(ts) AS started_at, max(ts) AS completed_at, CAST(min(ts) AS DATE) AS run_date
  FROM attempts GROUP BY run_id, task_id)"""


def event_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of the attempts table."""
    n = F.regexp_extract("task_id", "([0-9]+)$", 1).cast("int")
    return (
        attempts(spark, sf_dir)
        .select("task_id")
        .distinct()
        .select(
            "task_id",
            F.concat(F.lit("Task "), F.col("task_id")).alias("name"),
            F.array(F.concat(F.lit("https://"), F.col("task_id"), F.lit(".example.org/"))).alias("urls"),
            (n % 2 == 0).alias("deduplication_enabled"),
            F.when(n % 5 != 0, F.lit("openai")).alias("llm_provider"),
            F.when(n % 5 != 0, F.lit("gpt-4")).alias("llm_model"),
        )
    )


def shop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per customer, finished for even keys."""
    k = F.col("c_custkey")
    done = k % 2 == 0
    return table(spark, sf_dir, "customer").select(
        text("run-", k).alias("run_id"), text("task-", F.col("c_nationkey")).alias("task_id"),
        F.when(done, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.when(done, text("2024-01-02/run-", k, "/logs")).alias("logs_path"),
    )


SHOP_RUNS = """shop_runs AS (
  SELECT 'run-' || c_custkey AS run_id, 'task-' || c_nationkey AS task_id,
         CASE WHEN c_custkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status,
         CASE WHEN c_custkey % 2 = 0 THEN '2024-01-02/run-' || c_custkey || '/logs' END AS logs_path
  FROM customer)"""


def shop_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order, in the run of its customer."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        text("doc-", k).alias("id"), text("run-", F.col("o_custkey")).alias("run_id"),
        text("https://shop.example.org/o/", k).alias("source_url"), F.col("o_orderpriority").alias("title"),
        text("2024-01-02/run-", F.col("o_custkey"), "/markdown/doc-", k, ".md").alias("markdown_path"),
        F.when(F.col("o_orderstatus") == "F", text("2024-01-02/run-", F.col("o_custkey"), "/json/doc-", k, ".json")).alias("json_path"),
    )


SHOP_DOCUMENTS = """shop_documents AS (
  SELECT 'doc-' || o_orderkey AS id, 'run-' || o_custkey AS run_id,
         'https://shop.example.org/o/' || o_orderkey AS source_url, o_orderpriority AS title,
         '2024-01-02/run-' || o_custkey || '/markdown/doc-' || o_orderkey || '.md' AS markdown_path,
         CASE WHEN o_orderstatus = 'F' THEN '2024-01-02/run-' || o_custkey || '/json/doc-' || o_orderkey || '.json' END AS json_path
  FROM orders)"""


def _line_media(spark: SparkSession, sf_dir: str, flags: tuple, prefix: str, ext: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin(*flags))
    key = text(F.col("l_orderkey"), "-", F.col("l_linenumber"), "-", F.col("l_partkey"), "-", F.col("l_suppkey"))
    return li.select(
        F.concat(F.lit(prefix), key).alias("id"), text("doc-", F.col("l_orderkey")).alias("document_id"),
        text("https://cdn.example.org/", F.col("l_partkey"), ext).alias("original_url"),
        F.when(F.col("l_linestatus") == "F", text("media/", F.col("l_partkey"), ext)).alias("minio_path"),
        F.when(F.col("l_linestatus") == "F", F.lit("success")).otherwise(F.lit("failed")).alias("download_status"),
    )


def shop_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the order documents, from the line items that were not returned."""
    return _line_media(spark, sf_dir, ("N", "A"), "img-", ".png")


def shop_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of the order documents, from the returned line items."""
    return _line_media(spark, sf_dir, ("R",), "att-", ".pdf")


def _line_media_sql(view: str, flags: str, prefix: str, ext: str) -> str:
    return f"""{view} AS (
  SELECT '{prefix}' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
         'doc-' || l_orderkey AS document_id, 'https://cdn.example.org/' || l_partkey || '{ext}' AS original_url,
         CASE WHEN l_linestatus = 'F' THEN 'media/' || l_partkey || '{ext}' END AS minio_path,
         CASE WHEN l_linestatus = 'F' THEN 'success' ELSE 'failed' END AS download_status
  FROM lineitem WHERE l_returnflag IN ({flags}))"""


SHOP_IMAGES = _line_media_sql("shop_images", "'N','A'", "img-", ".png")
SHOP_ATTACHMENTS = _line_media_sql("shop_attachments", "'R'", "att-", ".pdf")


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
