"""Queries over task tables and the frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import frontier, runs, tasks as ops, upsert
from pagemill.plans import inputs
from pagemill.plans.inputs import table, text


def _tasks(spark, sf_dir):
    """A task per customer with URLs, flags and a creation date."""
    k = F.col("c_custkey")
    url = text("https://site", k % 50, ".example.org/")
    name = F.when(k % 13 == 0, F.lit("")).when(k % 13 == 1, F.repeat(F.lit("x"), 256)).otherwise(F.col("c_name"))
    listed = (
        F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 7 == 1, F.array(url, F.lit("ftp://x.example.org")))
        .when(k % 7 == 2, F.array(F.lit("HTTP://upper.example.org"))).otherwise(F.array(url, text(url, "b"), url))
    )
    return table(spark, sf_dir, "customer").select(
        text("task-", k).alias("task_id"), name.alias("name"), listed.alias("urls"), (k % 3 != 0).alias("deduplication_enabled"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")).cast("timestamp_ntz").alias("created_at"), "c_custkey",
    )


_TASKS = """tasks AS (
  SELECT 'task-' || c_custkey AS task_id,
         CASE c_custkey % 13 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 256) ELSE c_name END AS name,
         CASE c_custkey % 7 WHEN 0 THEN CAST([] AS VARCHAR[])
              WHEN 1 THEN ['https://site' || (c_custkey % 50) || '.example.org/', 'ftp://x.example.org']
              WHEN 2 THEN ['HTTP://upper.example.org']
              ELSE ['https://site' || (c_custkey % 50) || '.example.org/', 'https://site' || (c_custkey % 50) || '.example.org/b',
                    'https://site' || (c_custkey % 50) || '.example.org/'] END AS urls,
         c_custkey % 3 <> 0 AS deduplication_enabled,
         CAST(DATE '2024-01-01' + CAST(c_custkey % 400 AS INTEGER) AS TIMESTAMP) AS created_at, c_custkey FROM customer)"""


def task_validation(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    return t.select("task_id", F.array_join(frontier.validation_errors(F.col("name"), F.col("urls")), "; ").alias("reasons"))


def task_page(spark, sf_dir):
    return ops.list_tasks(_tasks(spark, sf_dir), 40, 100).select("task_id", "name", "created_at")


def task_page_by_key(spark, sf_dir):
    """The same page, reached from the last key of the forty tasks before it."""
    t = _tasks(spark, sf_dir).select("task_id", "name", "created_at")
    before = ops.list_tasks_after(t, None, 40).collect()  # one page
    return ops.list_tasks_after(t, (before[-1]["created_at"], before[-1]["task_id"]) if before else None, 100)


def task_lookup(spark, sf_dir):
    """One task by id: the filter reaches the scan."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return t.where(F.col("id") == 42)


def documents_of_run(spark, sf_dir):
    """Documents of one run: the filter reaches the scan, which reads three columns."""
    d = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("title")
    )
    return d.where(F.col("run_id") == 7)


def frontier_dedup(spark, sf_dir):
    """Task URLs minus the registry, then the first successful occurrence per URL."""
    urls = frontier.task_urls(_tasks(spark, sf_dir), "deduplication_enabled")
    registry = (
        table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
        .select(text("https://site", F.col("user_id") % 40, ".example.org/").alias("url")).distinct()
    )
    open_ = frontier.minus_registry(urls, registry)
    n = F.regexp_extract("task_id", "([0-9]+)$", 1).cast("int")
    tried = open_.select(
        F.col("task_id").alias("run_id"), "idx", "url", "deduplication_enabled", ((n + F.col("idx")) % 4 != 0).alias("ok")
    )
    return frontier.processed_occurrences(tried).select("run_id", "idx", "url", "ok")


def registry_merge(spark, sf_dir):
    """Crawls up to a date form the registry, the later ones are merged in."""
    crawls = table(spark, sf_dir, "events").select(
        text("https://e.example.org/", F.col("user_id")).alias("url"), F.col("event_type").alias("task_id"), "ts"
    )
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old = upsert.registry_rows(crawls.where(F.col("ts") < cut))
    return upsert.merge_registry(old, upsert.registry_rows(crawls.where(F.col("ts") >= cut)))


def _upserted(spark, sf_dir, flags, prefix, extra):
    """Line items as media rows: the ones shipped before 1998 are the table, the later ones the batch."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin(*flags))
    rows = li.select(
        text("doc-", F.col("l_orderkey") % 500).alias("document_id"), text("https://cdn.example.org/", F.col("l_partkey") % 50).alias("original_url"),
        F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        F.when(F.col("l_linenumber") % 2 == 0, text(prefix, F.col("l_suppkey"))).alias(extra),
        F.col("l_quantity").cast("bigint").alias("size_bytes"),
        F.when(F.col("l_linestatus") == "F", F.lit("success")).otherwise(F.lit("failed")).alias("download_status"),
    )
    keys, values = ["document_id", "original_url"], [extra, "size_bytes", "download_status"]
    order = ["ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "size_bytes"]
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    empty = "id string, document_id string, original_url string, created_at timestamp_ntz, updated_at timestamp_ntz, size_bytes bigint, download_status string, "
    start = spark.createDataFrame([], empty + f"{extra} string")
    new_id = F.substring(F.md5(F.concat_ws("|", *keys)), 1, 12)
    now = upsert.upsert(start, rows.where(F.col("ts") < cut), keys=keys, values=values, order=order, new_id=new_id)
    return upsert.upsert(now, rows.where(F.col("ts") >= cut), keys=keys, values=values, order=order, new_id=new_id)


def image_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir, ("N", "A"), "alt ", "alt_text")


def attachment_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir, ("R",), "file-", "filename")


def document_upsert(spark, sf_dir):
    """Orders before 1998 are the document table, later ones the batch; NULL titles overwrite."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        text("run-", F.col("o_custkey") % 40).alias("run_id"), text("https://s.example.org/", F.col("o_orderkey") % 100).alias("source_url"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"), F.col("o_orderkey").alias("content"),
        F.col("o_orderdate").alias("ts"), "o_orderkey",
    )
    keys, values, order = ["run_id", "source_url"], ["title", "content"], ["ts", "o_orderkey"]
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    old = upsert.collapse(rows.where(F.col("ts") < cut), keys, order).select(
        F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 16).alias("id"), *keys, *values,
        F.col("first_ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )
    new_id = F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 16)
    return upsert.upsert(old, rows.where(F.col("ts") >= cut), keys=keys, values=values, order=order, new_id=new_id)


def task_partial_update(spark, sf_dir):
    """Patches name the fields they set; an explicit null clears, an absent field stays."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), F.col("c_nationkey").alias("fallback_max_size_mb"))
    patch = (
        F.when(k % 4 == 0, F.lit('{"name":"new","fallback_max_size_mb":99}')).when(k % 4 == 1, F.lit('{"description":null}'))
        .when(k % 4 == 2, F.lit("{}"))
    )
    patches = table(spark, sf_dir, "customer").select("c_custkey", patch.alias("patch")).where(F.col("patch").isNotNull())
    fields = {"name": "string", "description": "string", "fallback_max_size_mb": "int"}
    return upsert.apply_patches(rows, patches, key="c_custkey", fields=fields)


def task_cascade_delete(spark, sf_dir):
    """Rows left per table and run after deleting the tasks of every third nation."""
    nation = table(spark, sf_dir, "nation").select(text("task-", F.col("n_nationkey")).alias("task_id"), "n_nationkey")
    registry = table(spark, sf_dir, "supplier").select(text("task-", F.col("s_nationkey")).alias("task_id"), F.col("s_name").alias("url"))
    kept = runs.cascade_delete(
        nation.where(F.col("n_nationkey") % 3 == 0), tasks=nation, runs=inputs.shop_runs(spark, sf_dir),
        documents=inputs.shop_documents(spark, sf_dir), images=inputs.shop_images(spark, sf_dir),
        attachments=inputs.shop_attachments(spark, sf_dir), registry=registry,
    )
    key = {"tasks": "task_id", "runs": "run_id", "documents": "id", "images": "id", "attachments": "id", "registry": "url"}
    parts = [df.select(F.lit(n).alias("table_name"), F.col(key[n]).alias("key")) for n, df in kept.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def only_after_filter(spark, sf_dir):
    """Orders as dated content against a per-task date; unknown dates stay."""
    d = F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy/M/d"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("published"), (F.col("o_custkey") % 5).alias("c"))
    after = F.when(F.col("c") != 0, F.make_timestamp_ntz(F.col("c").cast("int") + 1995, F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return frontier.published_after(rows, "published", after).select("o_orderkey", "published")


def provider_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.get(F.array(*map(F.lit, ("openai", "Qwen", "ernie", "deepseek", "anthropic"))), (F.col("p_partkey") % 5).cast("int")).alias("llm_provider"),
        F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("org/"), F.col("p_type"))).otherwise(F.col("p_type")).alias("llm_model"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("https://own.example.org")).when(F.col("p_partkey") % 3 == 1, F.lit("")).alias("base_url"),
    )
    return ops.resolve_providers(p, ops.providers(spark)).select("p_partkey", "llm_provider", "full_model", "effective_base_url")


def param_merge(spark, sf_dir):
    """Defaults overlaid by task parameters, the whitelist of model parameters, and the merged provider and prompt."""
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    own = F.when(
        k % 4 != 3,
        F.create_map(
            F.lit("temperature"), F.when(k % 4 == 1, none).otherwise(F.lit("0.5")),
            F.lit("base_url"), F.lit("https://b.example.org"),
            F.when(k % 5 == 0, F.lit("api_token")).otherwise(F.lit("api_key")), text("key-", k),
            F.lit("secret_extra"), F.lit("1"),
        ),
    )
    defaults = F.create_map(F.lit("temperature"), F.lit("0.1"), F.lit("max_tokens"), F.lit("2000"))
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", ops.merge_params(defaults, own).alias("params"),
        F.coalesce(F.nullif(F.when(k % 6 == 0, F.lit("")).otherwise(F.lit("qwen")), F.lit("")), F.lit("openai")).alias("provider"),
        ops.effective_prompt(F.when(k % 2 == 0, text("prompt ", k)), F.lit("default prompt")).alias("prompt"),
    )
    shown = ops.model_params(F.col("params"))
    joined = F.array_join(
        F.array_sort(F.transform(F.map_entries(shown), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";"
    )
    cfg = ops.merged_config(F.col("provider"), F.lit("m"), F.col("params"))
    return s.select(
        "s_suppkey", "prompt", "provider", joined.alias("model_params"), cfg.isNotNull().alias("stage2_configured"),
        F.size(ops.without_secrets(F.col("params"))).alias("storable_params"),
    )


def template_resolution(spark, sf_dir):
    """Prompt and schema references of part-derived tasks against a library derived from the brands."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1)
    rows = p.select(
        "p_partkey",
        F.when(k % 6 == 0, F.lit("plain text")).when(k % 6 == 1, F.lit("@other/x.txt")).when(k % 6 == 2, F.lit("@prompt_templates"))
        .otherwise(text("@prompt_templates/b", brand, ".txt")).alias("prompt_template"),
        F.when(k % 5 == 0, F.lit('{"type":"object"}')).when(k % 5 == 1, F.lit("a plain string"))
        .otherwise(text("@schemas/b", brand, ".json")).alias("output_schema"),
    )
    brands = p.select(brand.cast("int").alias("b")).distinct().where("b % 4 <> 0")
    library = brands.select(
        F.lit("prompt_templates").alias("dir"), text("b", F.col("b"), ".txt").alias("file"), text("Extract brand ", F.col("b")).alias("content")
    ).unionByName(
        brands.select(
            F.lit("schemas").alias("dir"), text("b", F.col("b"), ".json").alias("file"),
            F.when(F.col("b") % 5 == 0, F.lit("{broken")).otherwise(text('{"title":"', F.col("b"), '"}')).alias("content"),
        )
    )
    done = ops.resolve_references(rows, library, "prompt_template", schema=False)
    return ops.resolve_references(done, library, "output_schema", schema=True)


QUERIES = {
    f.__name__: f
    for f in (
        task_validation, task_page, task_page_by_key, task_lookup, documents_of_run, frontier_dedup, registry_merge, document_upsert, image_upsert, attachment_upsert,
        task_partial_update, task_cascade_delete, only_after_filter, provider_resolution, param_merge, template_resolution,
    )
}


def _media_upsert_sql(flags: str, prefix: str, extra: str) -> str:
    order = "ts, l_orderkey, l_linenumber, l_suppkey, l_partkey, size_bytes"
    last = f"ROW_NUMBER() OVER (PARTITION BY document_id, original_url ORDER BY {', '.join(o + ' DESC' for o in order.split(', '))})"
    return f"""WITH m AS (
  SELECT 'doc-' || (l_orderkey % 500) AS document_id, 'https://cdn.example.org/' || (l_partkey % 50) AS original_url, l_shipdate AS ts,
         l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN '{prefix}' || l_suppkey END AS {extra},
         CAST(l_quantity AS BIGINT) AS size_bytes, CASE WHEN l_linestatus = 'F' THEN 'success' ELSE 'failed' END AS download_status
  FROM lineitem WHERE l_returnflag IN ({flags})),
r AS (SELECT *, {last} AS rn, min(ts) OVER (PARTITION BY document_id, original_url) AS created_at FROM m)
SELECT substr(md5(document_id || '|' || original_url), 1, 12) AS id, document_id, original_url, {extra}, size_bytes, download_status,
       created_at, ts AS updated_at FROM r WHERE rn = 1"""


ORACLES = {
    "task_validation": f"""WITH {_TASKS},
b AS (SELECT *, list_filter(urls, lambda u: NOT regexp_matches(u, '^https?://')) AS bad FROM tasks)
SELECT task_id, array_to_string(list_filter([
  CASE WHEN length(name) < 1 THEN 'name is empty' END, CASE WHEN length(name) > 255 THEN 'name is longer than 255' END,
  CASE WHEN len(urls) < 1 THEN 'At least one URL is required' END, CASE WHEN len(bad) > 0 THEN 'Invalid URL format: ' || bad[1] END],
  lambda x: x IS NOT NULL), '; ') AS reasons FROM b""",
    "task_page_by_key": f"WITH {_TASKS} SELECT task_id, name, created_at FROM tasks ORDER BY created_at, task_id LIMIT 100 OFFSET 40",
    "task_page": f"WITH {_TASKS} SELECT task_id, name, created_at FROM tasks ORDER BY created_at, task_id LIMIT 100 OFFSET 40",
    "task_lookup": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 42",
    "documents_of_run": "SELECT o_orderkey AS id, o_custkey AS run_id, o_orderpriority AS title FROM orders WHERE o_custkey = 7",
    "frontier_dedup": f"""WITH {_TASKS},
u AS (SELECT task_id, deduplication_enabled AS dd, unnest(urls) AS url, generate_subscripts(urls, 1) AS idx,
             c_custkey FROM tasks),
known AS (SELECT DISTINCT 'https://site' || (user_id % 40) || '.example.org/' AS url FROM events WHERE event_type = 'purchase'),
o AS (SELECT *, (c_custkey + idx) % 4 <> 0 AS ok FROM u WHERE NOT dd OR url NOT IN (SELECT url FROM known)),
w AS (SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY task_id, url ORDER BY idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT task_id AS run_id, CAST(idx AS INTEGER) AS idx, url, ok FROM w WHERE NOT dd OR before = 0""",
    "registry_merge": """SELECT 'https://e.example.org/' || user_id AS url, max_by(event_type, (ts, event_type)) AS task_id,
       min(ts) AS first_crawled_at, max(ts) AS last_crawled_at, count(*) AS crawl_count FROM events GROUP BY user_id""",
    "document_upsert": """WITH d AS (SELECT 'run-' || (o_custkey % 40) AS run_id, 'https://s.example.org/' || (o_orderkey % 100) AS source_url,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS title, o_orderkey AS content, o_orderdate AS ts FROM orders),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, source_url ORDER BY ts DESC, content DESC) AS rn,
             min(ts) OVER (PARTITION BY run_id, source_url) AS created_at FROM d)
SELECT substr(sha256(run_id || '|' || source_url), 1, 16) AS id, run_id, source_url, title, content, created_at, ts AS updated_at FROM r WHERE rn = 1""",
    "image_upsert": _media_upsert_sql("'N','A'", "alt ", "alt_text"),
    "attachment_upsert": _media_upsert_sql("'R'", "file-", "filename"),
    "task_partial_update": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS name,
       CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS description,
       CASE WHEN c_custkey % 4 = 0 THEN 99 ELSE c_nationkey END AS fallback_max_size_mb FROM customer""",
    "task_cascade_delete": inputs.with_views(inputs.SHOP_RUNS, inputs.SHOP_DOCUMENTS, inputs.SHOP_IMAGES, inputs.SHOP_ATTACHMENTS) + """,
gone_tasks AS (SELECT 'task-' || n_nationkey AS task_id FROM nation WHERE n_nationkey % 3 = 0),
gone_runs AS (SELECT run_id FROM shop_runs WHERE task_id IN (SELECT task_id FROM gone_tasks)),
gone_docs AS (SELECT id FROM shop_documents WHERE run_id IN (SELECT run_id FROM gone_runs))
SELECT 'tasks' AS table_name, 'task-' || n_nationkey AS key FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT 'runs', run_id FROM shop_runs WHERE task_id NOT IN (SELECT task_id FROM gone_tasks)
UNION ALL SELECT 'documents', id FROM shop_documents WHERE run_id NOT IN (SELECT run_id FROM gone_runs)
UNION ALL SELECT 'images', id FROM shop_images WHERE document_id NOT IN (SELECT id FROM gone_docs)
UNION ALL SELECT 'attachments', id FROM shop_attachments WHERE document_id NOT IN (SELECT id FROM gone_docs)
UNION ALL SELECT 'registry', s_name FROM supplier WHERE 'task-' || s_nationkey NOT IN (SELECT task_id FROM gone_tasks)""",
    "only_after_filter": """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a'
         ELSE year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) END AS published FROM orders
WHERE o_custkey % 5 = 0 OR o_orderkey % 9 = 0 OR CAST(o_orderdate AS DATE) > make_date(CAST(o_custkey % 5 + 1995 AS INTEGER), 6, 1)""",
    "provider_resolution": """WITH p AS (
  SELECT p_partkey, ['openai', 'Qwen', 'ernie', 'deepseek', 'anthropic'][p_partkey % 5 + 1] AS llm_provider,
         CASE WHEN p_partkey % 7 = 0 THEN 'org/' || p_type ELSE p_type END AS m, p_partkey % 3 AS b FROM part)
SELECT p_partkey, llm_provider, CASE WHEN lower(llm_provider) IN ('qwen', 'ernie') THEN 'openai/' || m
         WHEN llm_provider = 'deepseek' THEN 'deepseek/' || m WHEN contains(m, '/') THEN m ELSE llm_provider || '/' || m END AS full_model,
       CASE WHEN b = 0 THEN 'https://own.example.org' WHEN llm_provider = 'Qwen' THEN 'https://dashscope.aliyuncs.com/compatible-mode/v1'
            WHEN llm_provider = 'ernie' THEN 'https://aip.baidubce.com/rpc/2.0/ai_custom/v1/wenxinworkshop/chat' END AS effective_base_url FROM p""",
    "param_merge": """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'prompt ' || s_suppkey ELSE 'default prompt' END AS prompt,
       CASE WHEN s_suppkey % 6 = 0 THEN 'openai' ELSE 'qwen' END AS provider,
       CASE s_suppkey % 4 WHEN 3 THEN 'max_tokens=2000;temperature=0.1' WHEN 1 THEN 'base_url=https://b.example.org;max_tokens=2000;temperature=null'
            ELSE 'base_url=https://b.example.org;max_tokens=2000;temperature=0.5' END AS model_params,
       s_suppkey % 4 <> 3 AND s_suppkey % 5 <> 0 AS stage2_configured,
       CASE WHEN s_suppkey % 4 = 3 THEN 2 ELSE 4 END AS storable_params FROM supplier""",
    "template_resolution": """WITH p AS (SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS b FROM part)
SELECT p_partkey,
       CASE p_partkey % 6 WHEN 0 THEN 'plain text' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE CASE WHEN b % 4 <> 0 THEN 'Extract brand ' || b END END AS prompt_template,
       CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Invalid directory in reference: @other/x.txt'
            WHEN 2 THEN 'Invalid file reference format: @prompt_templates'
            ELSE CASE WHEN b % 4 = 0 THEN 'Referenced file not found: @prompt_templates/b' || b || '.txt' END END AS prompt_template_error,
       CASE p_partkey % 5 WHEN 0 THEN '{"type":"object"}' WHEN 1 THEN NULL ELSE CASE WHEN b % 4 <> 0 AND b % 5 <> 0 THEN '{"title":"' || b || '"}' END END AS output_schema,
       CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Invalid schema format: a plain string'
            ELSE CASE WHEN b % 4 = 0 THEN 'Referenced file not found: @schemas/b' || b || '.json'
                      WHEN b % 5 = 0 THEN 'Invalid JSON in schema file @schemas/b' || b || '.json' END END AS output_schema_error FROM p""",
}
