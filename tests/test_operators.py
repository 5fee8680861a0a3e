import datetime as dt
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from pagemill.operators import extract, frontier, media, runs, tasks, upsert


def ts(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def rowset(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- upserts --------------------------------------------------------------------------------

DOC = "id string, k string, title string, n int, created_at timestamp_ntz, updated_at timestamp_ntz"


def _upsert(spark, current, batch):
    return upsert.upsert(current, batch, keys=["k"], values=["title", "n"], order=["ts", "seq"], new_id=F.concat(F.lit("id-"), F.col("k")))


def test_upsert_keeps_identity_overwrites_nulls_and_is_idempotent(spark):
    current = spark.createDataFrame([("a", "x", "old", 1, ts(1), ts(1)), ("b", "y", "stay", 2, ts(1), ts(1))], DOC)
    batch = spark.createDataFrame(
        [("x", "mid", 5, ts(2), 1), ("x", None, 6, ts(3), 2), ("z", "first", 7, ts(2), 3), ("z", "last", 8, ts(4), 4)],
        "k string, title string, n int, ts timestamp_ntz, seq int",
    )
    once = _upsert(spark, current, batch)
    want = [
        ("a", "x", None, 6, ts(1), ts(3)), ("b", "y", "stay", 2, ts(1), ts(1)), ("id-z", "z", "last", 8, ts(2), ts(4)),
    ]
    cols = ["id", "k", "title", "n", "created_at", "updated_at"]
    assert rowset(once, *cols) == want
    assert rowset(_upsert(spark, once, batch), *cols) == want


def test_registry_merge_is_associative(spark):
    rows = [("u", "t1", ts(1)), ("u", "t2", ts(3)), ("v", "t1", ts(2)), ("u", "t3", ts(2))]
    df = spark.createDataFrame(rows, "url string, task_id string, ts timestamp_ntz")
    whole = upsert.registry_rows(df)
    parts = upsert.merge_registry(upsert.registry_rows(df.where(F.col("ts") < ts(2))), upsert.registry_rows(df.where(F.col("ts") >= ts(2))))
    cols = ["url", "task_id", "first_crawled_at", "last_crawled_at", "crawl_count"]
    assert rowset(whole, *cols) == rowset(parts, *cols) == [("u", "t2", ts(1), ts(3), 3), ("v", "t1", ts(2), ts(2), 1)]


def test_patches(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k int, name string, n int")
    patches = spark.createDataFrame([(1, '{"name":null}'), (2, '{"n":9,"other":1}')], "k int, patch string")
    got = upsert.apply_patches(rows, patches, key="k", fields={"name": "string", "n": "int"})
    assert rowset(got, "k", "name", "n") == [(1, None, 1), (2, "b", 9), (3, "c", 3)]


# --- frontier -------------------------------------------------------------------------------

def test_validation_and_quarantine(spark):
    rows = [("ok", ["http://a"]), ("", ["https://a"]), ("x" * 256, ["https://a"]), ("n", []), ("n", ["HTTP://a"]), ("n", ["https://a", "ftp://b"]), (None, None)]
    good, bad = frontier.validated(spark.createDataFrame(rows, "name string, urls array<string>"))
    assert rowset(good, "name") == [("ok",)]
    assert bad.count() == 6
    assert [r.reasons for r in bad.where("name = 'n' AND size(urls) = 2").collect()] == [["Invalid URL format: ftp://b"]]


def test_registry_is_global_and_optional(spark):
    tasks_df = spark.createDataFrame([("t1", True, ["a", "b", "a"]), ("t2", False, ["a"]), ("t3", None, ["b"])], "task_id string, deduplication_enabled boolean, urls array<string>")
    f = frontier.task_urls(tasks_df, "deduplication_enabled")
    known = spark.createDataFrame([("b",)], "url string")
    assert rowset(frontier.minus_registry(f, known), "task_id", "idx", "url") == [("t1", 1, "a"), ("t1", 3, "a"), ("t2", 1, "a")]


def test_failures_retry_until_first_success(spark):
    rows = [("r", 1, "u", False), ("r", 2, "u", True), ("r", 3, "u", True), ("r", 4, "u", False), ("r", 1, "v", False), ("r", 5, "v", False)]
    df = spark.createDataFrame(rows, "run_id string, idx int, url string, ok boolean").withColumn("deduplication_enabled", F.lit(True))
    every = df.withColumn("deduplication_enabled", F.lit(False))
    assert frontier.processed_occurrences(every).count() == 6
    assert rowset(frontier.processed_occurrences(df), "url", "idx") == [("u", 1), ("u", 2), ("v", 1), ("v", 5)]


def test_first_successes_are_neither_copied_nor_broadcast(spark):
    """A URL over many stretches of places keeps its first success; the join's other side has no more rows than the attempts."""
    rows = spark.range(6000).select(F.lit("r").alias("run_id"), (F.col("id") + 1).cast("int").alias("idx"), F.lit("u").alias("url"), (F.col("id") >= 4200).alias("ok"), F.lit(True).alias("deduplication_enabled"))
    lone = spark.createDataFrame([(None, 1, "u", True, True), ("r", None, "u", True, True), ("s", 1, None, True, True)], "run_id string, idx int, url string, ok boolean, deduplication_enabled boolean")
    kept = frontier.processed_occurrences(rows.unionByName(lone))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan and "SortMergeJoin" in plan
    assert kept.where("run_id = 'r'").agg(F.max("idx"), F.count("idx"), F.count("*")).first()[:] == (4201, 4201, 4202)
    assert kept.where("run_id is null or url is null").count() == 2


def test_list_to_detail(spark):
    data = '{"items":[{"title":"a","url":"/d/1"},{"title":"b","url":"mailto:x"},{"title":"c","url":"https://o/2"}]}'
    df = spark.createDataFrame([(1, "https://s/list/", data), (2, "https://s/", None)], "page_id int, url string, structured_data string")
    assert rowset(frontier.items_frontier(df), "pos", "detail_url") == [(1, "https://s/d/1"), (3, "https://o/2")]


def test_only_after(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-01",), ("soon",), (None,)], "d string")
    after = F.lit("2024-01-02").cast("timestamp_ntz")
    assert {r.d for r in frontier.published_after(df, "d", after).collect()} == {"2024-01-05", "soon", None}
    assert {r.d for r in frontier.published_after(df, "d", after, keep_unknown=False).collect()} == {"2024-01-05"}
    assert frontier.published_after(df, "d", F.lit(None).cast("timestamp_ntz"), keep_unknown=False).count() == 4


# --- runs -----------------------------------------------------------------------------------

ATT = ("run_id string, task_id string, url string, idx int, ts timestamp_ntz, crawl_ok boolean, crawl_error string, stage2_enabled boolean, "
       "stage2_success boolean, stage2_error string, saved boolean, exception string")


def attempt(run, idx, ok=True, err=None, enabled=True, success=True, s2=None, saved=True, exc=None):
    return (run, "t", f"u{idx}", idx, ts(1, minute=idx % 60), ok, err, enabled, success, s2, saved, exc)


def test_counters_count_late_exceptions_twice(spark):
    rows = [attempt("r", 1), attempt("r", 2, ok=False, err="x", success=False, saved=False), attempt("r", 3, exc="boom"),
            attempt("r", 4, success=False, s2="bad")]
    df = spark.createDataFrame(rows, ATT)
    c = runs.counters(df).first()
    assert (c.urls_crawled, c.urls_failed, c.documents_created, c.stage2_successes, c.stage2_errors) == (3, 2, 3, 2, 1)
    e = rowset(runs.errors(df), "idx", "stage", "error")
    assert e == [(2, "crawl", "x"), (3, None, "boom"), (4, "stage2", "Stage 2 extraction failed: bad")]


def test_first_errors_and_chunks(spark):
    rows = [attempt("few", i, ok=False, err=f"e{i}", success=False) for i in (3, 1, 2)] + [
        attempt("many", i, ok=False, err=f"e{i}", success=False) for i in (2500, 1, 999, 1000, 1001, 7, 5)
    ] + [attempt("none", 1)]
    err = runs.errors(spark.createDataFrame(rows, ATT))
    first = runs.first_errors(err)
    assert rowset(first.where("run_id = 'many'"), "rn", "idx") == [(1, 1), (2, 5), (3, 7), (4, 999), (5, 1000)]
    assert first.where("run_id = 'few'").count() == 3 and first.where("run_id = 'none'").count() == 0
    log = {(r.run_id, r.chunk): r for r in runs.error_log(err).collect()}
    assert [e.idx for e in log["many", 0].errors] == [1, 5, 7, 999, 1000]
    assert [e.idx for e in log["many", 1].errors] == [1001] and [e.idx for e in log["many", 2].errors] == [2500]
    assert log["many", 2].total_errors == 7 and len(log) == 4


def test_rank_limit_runs_before_the_shuffle(spark):
    err = runs.errors(spark.createDataFrame([attempt("r", 1, ok=False)], ATT))
    plan = runs.first_errors(err)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_stage_labels(spark):
    df = spark.createDataFrame([(1, 2, 0, True), (1, 0, 3, True), (0, 0, 0, True), (0, 0, 0, False), (1, 0, 0, False)], "d int, s int, f int, c boolean")
    got = [r[0] for r in df.select(runs.stage_label(F.col("d"), F.col("s"), F.col("f"), F.col("c"))).collect()]
    assert got == [
        "Stage 1 (crawl4ai cleaning), Stage 2 (LLM extraction): 2 documents", "Stage 1 (crawl4ai cleaning), Stage 2: FAILED (3 errors)",
        "Stage 2: ENABLED but no output", "Stage 2: DISABLED", "Stage 1 (crawl4ai cleaning), Stage 2: DISABLED",
    ]


def test_chunks_bound_a_hot_group_and_lose_nothing(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 5000, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 100)).alias("g"), F.concat(F.lit("i"), "id").alias("i"))
    c = runs.in_chunks(df, "g", "i", F.struct("i"), size=500).select("g", "chunk", F.size("items").alias("n"), "items")
    assert c.agg(F.sum("n")).first()[0] == 6000
    hot = c.where("g = 'hot'").agg(F.count("*"), F.max("n")).first()
    assert hot[0] == 10 and hot[1] < 650
    assert c.where("g <> 'hot'").agg(F.max("chunk")).first()[0] == 0
    assert c.select(F.explode("items.i").alias("i")).distinct().count() == 6000


def test_rows_without_id_or_place_stay(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("i"), "id")
    c = runs.in_chunks(df, "g", "i", F.struct("i", "id"), size=100)
    assert {r.id for r in c.select(F.explode("items.id").alias("id")).collect()} == set(range(3000))
    assert c.agg(F.max(F.size("items"))).first()[0] < 200 and c.where("chunk is null").count() == 0
    rows = [attempt("r", i, ok=False, err=f"e{i}", success=False) for i in (1, 2)] + [("r", "t", f"n{i}", None, ts(1), False, f"n{i}", True, False, None, False, None) for i in range(2500)]
    log = runs.error_log(runs.errors(spark.createDataFrame(rows, ATT))).collect()
    assert sum(len(r.errors) for r in log) == 2502 == log[0].total_errors
    lost = [r for r in log if r.chunk is None]
    assert len(lost) == 3 and all(len(r.errors) < 1000 for r in lost) and [e.idx for r in log if r.chunk == 0 for e in r.errors] == [1, 2]


def test_latest_status(spark):
    rows = [("r", ts(1), 1, "pending", None), ("r", ts(2), 2, "running", None), ("r", ts(3), 3, "failed", "m"), ("r", ts(3), 4, "completed", None)]
    df = spark.createDataFrame(rows, "run_id string, ts timestamp_ntz, seq int, status string, error_message string")
    assert rowset(runs.latest_status(df, overwritten=("error_message",)), "run_id", "status", "error_message") == [("r", "completed", "m")]


def test_gaps_across_days(spark):
    times = [("a", ts(1, 1)), ("b", ts(1, 1)), ("c", ts(1, 5)), ("d", ts(4, 0)), ("e", ts(9, 2))]
    df = spark.createDataFrame([(r, "t", t, t, None) for r, t in times], "run_id string, task_id string, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz")
    got = dict(rowset(runs.gaps(df), "run_id", "gap_seconds"))
    hour = 3600
    assert got == {"a": None, "b": 0, "c": 4 * hour, "d": 67 * hour, "e": 122 * hour}


def test_cascade_keeps_orphans(spark):
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    kept = runs.cascade_delete(
        s([("t1",)], "task_id string"), tasks=s([("t1",), ("t2",)], "task_id string"), runs=s([("r1", "t1"), ("r2", "t2")], "run_id string, task_id string"),
        documents=s([("d1", "r1"), ("d2", "r2"), ("d9", "r9")], "id string, run_id string"),
        images=s([("i1", "d1"), ("i2", "d2"), ("i9", "d8")], "id string, document_id string"),
        attachments=s([("a1", "d1")], "id string, document_id string"), registry=s([("u1", "t1"), ("u2", "t2")], "url string, task_id string"),
    )
    assert {k: sorted(r[0] if k in ("tasks", "registry") else (r.run_id if k == "runs" else r.id) for r in df.collect()) for k, df in kept.items()} == {
        "tasks": ["t2"], "runs": ["r2"], "documents": ["d2", "d9"], "images": ["i2", "i9"], "attachments": [], "registry": ["t2"]}


def test_logs_only_where_written(spark):
    df = spark.createDataFrame([("a", "p/a/logs"), ("b", None), ("c", "p/c/logs")], "run_id string, logs_path string").selectExpr("*", "'m' AS minio_path", "'x' AS manifest_path")
    counts = spark.createDataFrame([("a", 2), ("b", 1)], "run_id string, total_errors int")
    assert rowset(runs.log_locations(df, counts), "run_id", "error_log_path") == [("a", "p/a/logs/error_log.json"), ("c", None)]


# --- tasks ----------------------------------------------------------------------------------

def test_providers(spark):
    rows = [("openai", "gpt-4", None), ("openai", "org/gpt", None), ("QWEN", "qwen-plus", None), ("qwen", "q", "https://own"), ("deepseek", "deepseek-chat", "https://d"), ("deepseek", "x/y", "")]
    df = spark.createDataFrame(rows, "llm_provider string, llm_model string, base_url string")
    got = [tuple(r) for r in tasks.resolve_providers(df, tasks.providers(spark)).select("full_model", "effective_base_url").collect()]
    assert Counter(got) == Counter([
        ("openai/gpt-4", None), ("org/gpt", None), ("openai/qwen-plus", "https://dashscope.aliyuncs.com/compatible-mode/v1"), ("openai/q", "https://own"),
        ("deepseek/deepseek-chat", "https://d"), ("deepseek/x/y", None)])


def test_params(spark):
    df = spark.createDataFrame([({"temperature": None, "api_key": "k", "x": "1"},), ({"api_token": "k"},), (None,)], "p map<string,string>")
    m = tasks.merge_params(F.create_map(F.lit("temperature"), F.lit("0.1"), F.lit("n"), F.lit("1")), F.col("p"))
    rows = df.select(m.alias("m"), tasks.merged_config(F.lit("openai"), F.lit("gpt"), m).alias("c"), tasks.model_params(m).alias("w"), tasks.without_secrets(m).alias("s")).collect()
    assert rows[0].m == {"n": "1", "temperature": None, "api_key": "k", "x": "1"} and rows[0].c.provider == "openai"
    assert rows[0].w == {"n": "1", "temperature": None} and "api_key" not in rows[0].s
    assert rows[1].c is None and rows[2].m == {"temperature": "0.1", "n": "1"}


def test_references(spark):
    lib = spark.createDataFrame([("prompt_templates", "a.txt", "P"), ("schemas", "s.json", "{}"), ("schemas", "bad.json", "{x")], "dir string, file string, content string")
    p = spark.createDataFrame([("text",), ("@prompt_templates/a.txt",), ("@prompt_templates/no.txt",), ("@other/a.txt",), ("@x",), (None,)], "v string")
    got = [tuple(r) for r in tasks.resolve_references(p, lib, "v", schema=False).collect()]
    assert [(a, b and b.split(":")[0]) for a, b in sorted(got, key=repr)] == sorted(
        [("text", None), ("P", None), (None, "Referenced file not found"), (None, "Invalid directory in reference"), (None, "Invalid file reference format"), (None, None)], key=repr)
    s = spark.createDataFrame([("@schemas/s.json",), ("@schemas/bad.json",), ("plain",), ('{"a":1}',)], "v string")
    got = {r[0]: r[1] for r in tasks.resolve_references(s.withColumn("w", F.col("v")), lib, "v", schema=True).select("w", F.coalesce("v_error", "v")).collect()}
    assert got["@schemas/s.json"] == "{}" and got['{"a":1}'] == '{"a":1}'
    assert got["plain"].startswith("Invalid schema format") and got["@schemas/bad.json"].startswith("Invalid JSON in schema file")


# --- media and extractors -------------------------------------------------------------------

def test_media_states(spark):
    mb = 1024 * 1024
    rows = [("pre", True, True), ("small", False, True), ("edge", False, True), ("big", False, True), ("gone", False, True), ("off", False, False), (None, False, True), ("", False, True)]
    df = spark.createDataFrame(rows, "original_url string, downloaded boolean, fallback_enabled boolean").selectExpr("*", "2 AS max_size_mb", "'r' AS run_id", "date'2024-01-02' AS run_date")
    blobs = spark.createDataFrame([("small", 10, "image/png"), ("edge", 2 * mb, None), ("big", 2 * mb + 1, "x"), ("pre", 5, "x")], "original_url string, length bigint, mime_type string")
    got = {r.original_url: (r.download_status, r.download_method, r.size_bytes, r.mime_type) for r in media.resolve_media(df, blobs).collect()}
    assert got == {
        "pre": ("success", "crawl4ai", None, None), "small": ("success", "fallback", 10, "image/png"),
        "edge": ("success", "fallback", 2 * mb, "application/octet-stream"), "big": ("failed", None, None, None),
        "gone": ("failed", None, None, None), "off": ("skipped", None, None, None)}


def test_extractor_errors_become_rows(spark):
    df = spark.createDataFrame([("r", f"u{i}", "bad" if i == 3 else "ok", "p", None) for i in range(8)], "run_id string, url string, content string, prompt string, schema string")

    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["content"] == "bad").any():
            raise RuntimeError("no")
        return pd.DataFrame({"raw_content": batch["content"].str.upper(), "error": None})

    got = {r.url: (r.raw_content, r.error) for r in extract.extract_with(df, fn, attempt=2).collect()}
    assert len(got) == 8 and got["u3"] == (None, "no") and got["u1"] == ("OK", None)


def test_record_kinds(spark):
    from pagemill.functions import markup, records

    html = """<html lang=en><head><title>T</title><meta name=description content="D"><meta name=author content="Ann"><meta name=citation_author content="A B">
      <meta property="article:published_time" content="2024-02-03T04:05:06Z"><meta name=keywords content="a,b"></head><body><nav><a href="/x">x</a></nav>
      <article><h1>Head  line</h1><span class="brand big">Acme</span><b class=price>$1234.5</b><ul class="features"><li>f1</li><li>f2</li></ul>
      <dl><dt>Size</dt><dd>9</dd><dt>Size</dt><dd>10</dd></dl><p class=abstract>Abs tract</p><img src="i.png"></article></body></html>"""
    df = spark.createDataFrame([("https://h/d/", html)], "url string, html string").withColumn("canon", markup.canon(F.col("html")))
    import json

    got = {k: json.loads(extract.extract_by_rules(df, k).first().record) for k in extract.EXTRACTORS}
    assert got["article"]["title"] == "Head line" and got["article"]["author"] == "Ann" and got["article"]["published_date"] == "2024-02-03"
    assert got["article"]["keywords"] == ["a", "b"] and "x" not in got["article"]["content"].split()
    assert got["list_page"] == {"page_title": "T", "items": [{"title": "x", "url": "https://h/x"}], "total_count": 1}
    assert got["product"]["brand"] == "Acme" and got["product"]["price"] == "$1,234.50" and got["product"]["features"] == ["f1", "f2"]
    assert got["product"]["specifications"] == {"Size": "10"} and got["product"]["description"] == "D"
    assert got["paper"]["authors"] == ["A B"] and got["paper"]["abstract"] == "Abs tract"
    assert got["detail"]["images"] == ["https://h/d/i.png"]
    schema = '{"properties":{"title":{},"content":{}},"required":["title","content"]}'
    n = extract.extract_by_rules(df, "article").select(records.normalize(F.col("record"), F.lit(schema)).alias("n")).first().n
    assert n.error is None


def test_whole_run(spark):
    from pagemill.operators import crawl

    html = "<html><head><title>T{0}</title></head><body><nav>menu</nav><article><h1>H{0}</h1><p>Body text {0} is long enough.</p></article></body></html>"
    pages = spark.createDataFrame(
        [("https://a/1", html.format(1), True, None), ("https://a/2", html.format(2), True, None), ("https://a/3", None, False, "timeout")],
        "url string, html string, success boolean, error string",
    )
    schema = '{"properties":{"title":{},"content":{}},"required":["title","content"]}'
    rows = [
        ("r1", "t1", 1, "https://a/1", True, schema), ("r1", "t1", 2, "https://a/1", True, schema), ("r1", "t1", 3, "https://a/3", True, schema),
        ("r1", "t1", 4, "https://a/3", True, schema), ("r1", "t1", 5, "https://known", True, schema), ("r2", "t2", 1, "https://a/1", False, None),
        ("r2", "t2", 2, "https://a/1", False, None), ("r2", "t2", 3, "https://gone", False, '{"properties":{"x":{}},"required":["x"]}'),
        ("r2", "t2", 4, "https://a/2", False, '{"properties":{"x":{}},"required":["x"]}'),
    ]
    todo = spark.createDataFrame(rows, "run_id string, task_id string, idx int, url string, deduplication_enabled boolean, output_schema string").selectExpr(
        "*", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "'' AS css_selector", "'' AS content_selector", "CAST(NULL AS DOUBLE) AS content_filter_threshold",
        "true AS has_config", "'p' AS prompt", "true AS has_key", "true AS stage2_fallback_enabled")
    result = crawl.run(todo, spark.createDataFrame([("https://known",)], "url string"), pages)
    got = {(r.run_id, r.idx): (r.crawl_ok, r.crawl_error, r.stage2_success, r.stage2_error) for r in result.attempts.collect()}
    assert got == {
        ("r1", 1): (True, None, True, None), ("r1", 3): (False, "timeout", False, "Crawl failed: timeout"), ("r1", 4): (False, "timeout", False, "Crawl failed: timeout"),
        ("r2", 1): (True, None, True, None), ("r2", 2): (True, None, True, None),
        ("r2", 3): (False, crawl.NO_PAGE, False, f"Crawl failed: {crawl.NO_PAGE}"), ("r2", 4): (True, None, False, "Both primary and fallback extraction failed"),
    }
    docs = {(d.run_id, d.idx): d for d in result.documents.collect()}
    assert set(docs) == {("r1", 1), ("r2", 1), ("r2", 2), ("r2", 4)} and docs["r2", 4].structured_data is None
    assert docs["r1", 1].structured_data == '{"title":"H1","content":"H1 Body text 1 is long enough."}' and "menu" not in docs["r1", 1].content
    assert docs["r2", 1].id == docs["r2", 2].id != docs["r1", 1].id
    assert {(r.url, r.task_id, r.crawl_count) for r in result.registry_rows.collect()} == {("https://a/1", "t2", 3), ("https://a/2", "t2", 1)}
    c = {r.run_id: r for r in runs.counters(result.attempts).collect()}
    assert (c["r2"].urls_crawled, c["r2"].urls_failed, c["r2"].distinct_documents, c["r2"].stage2_errors) == (3, 1, 2, 1)
    assert {(e.run_id, e.stage) for e in runs.errors(result.attempts).collect()} == {("r1", "crawl"), ("r2", "crawl"), ("r2", "stage2")}


def test_hot_runs_are_dealt_by_chunk(spark):
    """Without broadcasts every list is gathered below a shuffle by run and chunk, and no join follows the lists."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("r").cast("string")).alias("g"), F.col("id").cast("string").alias("i"))
        c = runs.in_chunks(rows, "g", "i", F.struct("i"), size=100)
        plan = c._jdf.queryExecution().executedPlan().toString()
        gathered = plan.index("collect_list")
        assert "hashpartitioning(g" in plan and "chunk" in plan[plan.index("hashpartitioning(g") :].split(")")[0] and "Join" not in plan[:gathered]
        assert "salt" in plan
        assert c.agg(F.sum(F.size("items"))).first()[0] == 5000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_whole_run_takes_the_latest_page(spark):
    from pagemill.operators import crawl

    pages = spark.createDataFrame([(1, "u", "<h1>old</h1>"), (2, "u", "<h1>new</h1>")], "page_id int, url string, html string")
    todo = spark.sql(
        """SELECT 'r' run_id, 't' task_id, 1 idx, 'u' url, timestamp_ntz'2024-01-01' ts, true deduplication_enabled, '' css_selector, CAST(NULL AS STRING) content_selector,
        0.4d content_filter_threshold, true has_config, 'p' prompt, true has_key, CAST(NULL AS STRING) output_schema, false stage2_fallback_enabled"""
    )
    known = spark.createDataFrame([], "url string")
    got = crawl.run(todo, known, pages).pages.collect()
    assert [r.raw for r in got] == ["new"] and got[0].crawl_ok


def test_answers_of_one_attempt(spark):
    pages = spark.createDataFrame([("r", "u"), ("r", "v")], "run_id string, url string")
    out = spark.createDataFrame([("r", "u", 1, "z", 1), ("r", "u", 1, "a", 2), ("r", "v", 1, "k", 1), ("r", "v", 1, "k", 2)], "run_id string, url string, attempt int, raw_content string, seq int")
    get = lambda **k: {r.url: r.primary for r in extract.with_attempts(pages, out, **k).collect()}
    assert get() == {"u": None, "v": "k"} and get(order="seq") == {"u": "a", "v": "k"}


def test_paging_by_key(spark, tmp_path):
    """Pages by key, put together, are the list: ties, tasks without a date, and a filter that reaches the scan."""
    rows = [(f"t{i:03d}", None if i % 17 == 0 else ts(1 + i % 5)) for i in range(200)]
    spark.createDataFrame(rows, "task_id string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    seen, after = [], None
    while page := [tuple(r) for r in tasks.list_tasks_after(t, after, 23).collect()]:
        seen += page
        after = (page[-1][1], page[-1][0])
    assert seen == [tuple(r) for r in tasks.list_tasks(t, 0, 1000).collect()] and len(seen) == 200
    plan = tasks.list_tasks_after(t, (ts(2), "t010"), 23)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(created_at" in plan


def test_written_run_is_worked_out_once(spark):
    """The views of a written run read a table: no page, no pattern is left in their plans."""
    from pagemill.operators import crawl

    pages = spark.createDataFrame([(1, "u", "<h1>x</h1><p>word word</p>")], "page_id int, url string, html string")
    todo = spark.sql(
        """SELECT 'r' run_id, 't' task_id, 1 idx, 'u' url, timestamp_ntz'2024-01-01' ts, true deduplication_enabled, '' css_selector, CAST(NULL AS STRING) content_selector,
        0.4d content_filter_threshold, true has_config, 'p' prompt, true has_key, CAST(NULL AS STRING) output_schema, false stage2_fallback_enabled"""
    )
    lazy = crawl.run(todo, spark.createDataFrame([], "url string"), pages)
    once = lazy.written()
    assert [tuple(r) for r in once.attempts.collect()] == [tuple(r) for r in lazy.attempts.collect()]
    plan = runs.errors(once.attempts)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "html" not in plan.lower()


def test_facts_of_groups_are_not_copied_by_salts(spark):
    """Facts go to the chunks that there are, beside the items; only groups of several chunks are copied for the join."""
    rows = spark.range(1000).select(F.when(F.col("id") < 500, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 100).cast("string"))).alias("g"), F.col("id").cast("string").alias("i"))
    about = spark.createDataFrame([("hot", 1), ("g1", 2), ("g2", 3), ("g2", 3), ("g3", 4), ("g3", 5), ("unused", 6), (None, 7)], "g string, fact int")
    c = runs.in_chunks(rows.unionByName(spark.createDataFrame([(None, "x")], "g string, i string")), "g", "i", F.struct("i"), size=100, about=about)
    assert c.columns == ["g", "chunk", "fact", "items"]
    got = sorted((r.g, r.fact, r.n) for r in c.groupBy("g", "fact").agg(F.sum(F.size("items")).alias("n")).collect())
    assert got == [("g1", 2, 5), ("g2", 3, 10), ("g3", 4, 5), ("g3", 5, 5), ("hot", 1, 500)]
    assert c.where("g = 'hot'").count() == 5 and c.where("items <> sort_array(items)").count() == 0
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "(n_chunks#" in plan[plan.index("Filter") :] and "> 1" in plan
