import json
import os

import pytest
from pyspark.sql import functions as F

from pagemill.functions import page
from pagemill.operators import frontier, upsert
from pagemill.sources import readers, schemas, tables
from pagemill.streaming import jobs


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_task_files_json_and_yaml(spark, tmp_path):
    task = {"name": "n", "urls": ["https://a"], "output_schema": {"type": "object"}, "only_after_date": "2024-01-02T03:04:05", "crawl_config": {"css_selector": "p"}}
    write(tmp_path / "json", "a.json", json.dumps(task, indent=1))
    write(tmp_path / "json", "b.json", "{broken")
    write(tmp_path / "json", "c.json", json.dumps({**task, "only_after_date": "soon"}))
    rows = {os.path.basename(r.file): r for r in readers.task_files(spark, str(tmp_path / "json"), "json").collect()}
    a = rows["a.json"]
    assert (a.name, a.urls, a.output_schema, a.parse_error) == ("n", ["https://a"], '{"type":"object"}', None)
    assert a.crawl_config.css_selector == "p" and a.crawl_config.verbose is True and a.deduplication_enabled and a.fallback_max_size_mb == 10
    assert str(a.only_after_date) == "2024-01-02 03:04:05"
    assert rows["b.json"].parse_error and rows["c.json"].parse_error == "only_after_date is no ISO date"
    write(tmp_path / "yaml", "a.yaml", 'name: "中"\nurls:\n  - https://a\nprompt_template: "@prompt_templates/x.txt"\ndeduplication_enabled: false\n')
    y = readers.task_files(spark, str(tmp_path / "yaml"), "yaml").first()
    assert (y.name, y.prompt_template, y.deduplication_enabled) == ("中", "@prompt_templates/x.txt", False)
    with pytest.raises(ValueError):
        readers.task_files(spark, str(tmp_path), "toml")


def test_library_and_blobs(spark, tmp_path):
    write(tmp_path / "lib" / "prompt_templates", "x.txt", "line 1\nline 2")
    write(tmp_path / "lib" / "schemas", "中.json", "{}")
    assert sorted(tuple(r) for r in readers.library(spark, str(tmp_path / "lib")).collect()) == [
        ("prompt_templates", "x.txt", "line 1\nline 2"), ("schemas", "中.json", "{}")]
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "ok.png").write_bytes(b"x" * 1024 * 1024)
    (tmp_path / "blobs" / "big.bin").write_bytes(b"x" * (1024 * 1024 + 1))
    got = readers.blobs(spark, str(tmp_path / "blobs"), max_size_mb=1, content=True).collect()
    assert [(r.filename, r.length, r.mime_type, len(r.content)) for r in got] == [("ok.png", 1024 * 1024, "image/png", 1024 * 1024)]


def test_snapshots_switch_versions(spark, tmp_path):
    base = str(tmp_path / "t")
    tables.write_version(spark.range(3), base, 1)
    grown = tables.read_current(spark, base).union(spark.range(10, 12))
    tables.write_version(grown, base, 2)
    tables.write_version(grown, base, 2)  # a retry replaces the same version
    assert sorted(r.id for r in tables.read_current(spark, base).collect()) == [0, 1, 2, 10, 11]


def test_sink_replaces_only_its_runs(spark, tmp_path):
    base = str(tmp_path / "s")
    d = lambda rows: spark.createDataFrame(rows, "run_date string, run_id string, v int")
    tables.write_by_run(d([("2024-01-01", "a", 1), ("2024-01-01", "b", 2)]), base)
    tables.write_by_run(d([("2024-01-01", "b", 3)]), base)
    assert sorted((r.run_id, r.v) for r in spark.read.parquet(base).collect()) == [("a", 1), ("b", 3)]


def test_run_logs_and_exports(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01", "a", "{}")], "run_date string, run_id string, manifest string")
    tables.write_run_logs(d, d, d.limit(0), str(tmp_path / "logs"))
    assert os.path.isdir(tmp_path / "logs" / "run_manifest" / "run_date=2024-01-01" / "run_id=a")
    rows = spark.createDataFrame([('{"name":"中"}',), ('{"name":"b"}',)], "task string")
    tables.export_tasks(rows, str(tmp_path / "y"), "yaml")
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "y"), wholetext=True).collect())
    import yaml

    assert sorted(d["name"] for d in yaml.safe_load_all(text)) == ["b", "中"]
    with pytest.raises(ValueError):
        tables.export_tasks(rows, str(tmp_path / "z"), "xml")


def test_views_name_existing_columns(spark):
    for kind, ddl in (("task", schemas.TASKS), ("run", schemas.RUNS), ("document", schemas.DOCUMENTS), ("image", schemas.IMAGES), ("attachment", schemas.ATTACHMENTS)):
        schemas.view(spark.createDataFrame([], ddl), kind)


# --- streaming ------------------------------------------------------------------------------

CRAWLS = "url string, task_id string, ts timestamp_ntz"


def crawl_files(spark, folder):
    import datetime as dt

    for i in range(4):
        rows = [(f"u{j % 5}", f"t{i}", dt.datetime(2024, 1, 1 + i, j)) for j in range(12)]
        spark.createDataFrame(rows, CRAWLS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(CRAWLS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_registry_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = crawl_files(spark, src)
    jobs.registry_deltas(stream, out, str(tmp_path / "cp"))
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) == 4
    want = sorted(map(tuple, upsert.registry_rows(spark.read.parquet(src)).collect()))
    assert sorted(map(tuple, jobs.read_registry(spark, out).collect())) == want
    snaps = str(tmp_path / "snapshots")
    jobs.compact_registry(spark, out, snaps, first=True)
    assert sorted(map(tuple, jobs.read_registry(spark, out, snaps).collect())) == want
    jobs.registry_deltas(stream, out, str(tmp_path / "cp"))  # nothing new, nothing counted twice
    assert sorted(map(tuple, jobs.read_registry(spark, out).collect())) == want


def test_bounded_dedup_over_batches(spark, tmp_path):
    stream = crawl_files(spark, str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.run_available(jobs.dedup_bounded(stream, "url", "ts", "30 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"u{i}" for i in range(5)]


def test_monitor_drops_late_rows_only(spark, tmp_path):
    import datetime as dt

    src = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "ts timestamp_ntz, crawl_ok boolean").coalesce(1).write.mode("append").parquet(src)
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda: jobs.monitor_updates(jobs.monitor(spark.readStream.schema("ts timestamp_ntz, crawl_ok boolean").parquet(src)), out, cp)
    put([(at(1, 5), True), (at(1, 50), False), (at(10), True)])
    run()
    put([(at(10, 30), True), (at(9, 30), True), (at(1, 30), True)])  # the last one is beyond the watermark of 08:00
    run()
    got = sorted((r.window_start.hour, r.status, r.n) for r in jobs.read_monitor(spark, out).collect())
    assert got == [(1, "failure", 1), (1, "success", 1), (9, "success", 1), (10, "success", 2)]


def test_ingest_equals_batch(spark, sf_dir, tmp_path):
    stream = readers.page_stream(spark, f"{sf_dir}/pages.parquet")
    jobs.run_available(jobs.ingest(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = jobs.ingest(readers.pages(spark, f"{sf_dir}/pages.parquet"))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)) == key(batch)


def test_compaction_between_batches(spark, tmp_path):
    src, out, snaps, cp = (str(tmp_path / n) for n in ("in", "out", "snaps", "cp"))
    jobs.registry_deltas(crawl_files(spark, src), out, cp)
    jobs.compact_registry(spark, out, snaps, first=True)
    jobs.registry_deltas(crawl_files(spark, src), out, cp)
    want = sorted(map(tuple, upsert.registry_rows(spark.read.parquet(src)).collect()))
    assert sorted(map(tuple, jobs.read_registry(spark, out, snaps).collect())) == want
    jobs.compact_registry(spark, out, snaps)
    assert sorted(map(tuple, jobs.read_registry(spark, out, snaps).collect())) == want
    left = sorted(int(d[6:]) for d in os.listdir(out) if d.startswith("batch="))
    assert left == [4, 5, 6, 7]  # what the first snapshot held already is gone


def test_exact_dedup_over_batches_and_a_repeated_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    ddl = "seq bigint, url string, deduplication_enabled boolean"
    for part in ([(1, "a", True), (2, "a", True), (3, "b", False)], [(4, "a", True), (5, "b", False), (6, "c", None), (7, "known", True)], [(8, "c", True), (9, "d", True)]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    known = lambda: spark.createDataFrame([("known",)], "url string")
    jobs.dedup_exact(stream, known, out, cp)
    urls = lambda: sorted(r.url for r in spark.read.parquet(out).collect())
    assert urls() == ["a", "b", "b", "c", "d"]
    for name in ("2", ".2.crc"):
        os.remove(f"{cp}/commits/{name}")  # as if the last batch had failed after writing
    jobs.dedup_exact(stream, known, out, cp)
    assert urls() == ["a", "b", "b", "c", "d"]


def test_packed_artifacts(spark, tmp_path):
    """Files follow the bytes, not the runs; one run is read from the files that the index names."""
    base = f"{tmp_path}/packed"
    rows = spark.range(20_000).selectExpr("date'2024-01-01' + cast(id % 30 as int) as run_date", "concat('run-', id % 3000) as run_id", "if(id % 2 = 0, 'a', 'b') as kind", "repeat(cast(id as string), 20) as content")
    tables.write_packed(rows, base, 0)
    few = list((tmp_path / "packed/data/batch=0").glob("*.parquet"))
    assert 1 <= len(few) <= 16
    one = tables.read_run(spark, base, "run-17")
    assert len(one.inputFiles()) == 1 and one.count() == rows.where("run_id = 'run-17'").count()
    assert tables.read_run(spark, base, "run-17", "a").count() == 0 and tables.read_run(spark, base, "none").count() == 0
    assert tables.packed_index(spark, base).agg({"n": "sum"}).first()[0] == 20_000 == tables.read_packed(spark, base).count()
    again = spark.createDataFrame([("2024-01-01", None, None, None), ("2024-01-01", "run-x", "a", "")], "run_date string, run_id string, kind string, content string")
    for _ in range(2):
        tables.write_packed(again, base, 0)
        tables.write_packed(again.limit(0), base, 1)
    assert tables.read_packed(spark, base).count() == 2 and tables.read_run(spark, base, "run-x").first().content == ""


def test_narrow_rows_of_costly_work_are_dealt_to_all_tasks(spark, sf_dir):
    """One split or many: the pages made of parts and the task texts are worked on in as many tasks as the session has."""
    from pagemill.plans import inputs, pages

    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert inputs.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == wanted
    assert pages.product_records(spark, sf_dir).rdd.getNumPartitions() == wanted


def test_yaml_is_parsed_once_and_in_all_tasks(spark, sf_dir):
    """The filter on parse errors isn't pushed below the dealing of rows, with a second round trip of its own."""
    from pagemill.plans import flows

    plan = flows.task_yaml_round_trip(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("RoundRobinPartitioning")


def test_media_files_are_written_by_several_tasks(spark, sf_dir):
    """A folder a page: few splits of pages must not leave all the files to few tasks."""
    from pagemill.plans import flows

    files = flows.blob_index(spark, sf_dir).inputFiles()
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in files}) > 1


def test_media_files_share_folders(spark, sf_dir):
    """A folder a page, made by Hadoop, was most of the time of storing them."""
    from pagemill.plans import flows

    files = flows.blob_index(spark, sf_dir).inputFiles()
    assert files and len({f.rsplit("/", 1)[0] for f in files}) <= len(files) // 2


def test_files_are_the_same_in_any_store(spark, tmp_path, monkeypatch):
    """Rows of a key share a file; null values, null keys and keys with signs; folders that are full; a task that runs again."""
    monkeypatch.setattr(tables, "FOLDER", 2)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./out", f"file://{tmp_path}")
    rows = [(1, "a", 1), (1, "bé", 2), (2, None, 3), (3, "", 1), (None, "n", 1), (5, "x\ny", 400), (6, "c", 0), (6, "d", None)]
    want = {"1": ["a", "bébé"], "2": [""], "3": [""], "__HIVE_DEFAULT_PARTITION__": ["n"], "5": ["x\ny" * 400], "6": ["", ""]}
    for base in (f"file://{tmp_path}/plain", f"{tmp_path}/plain", "viewfs://files/out/other"):
        df = spark.createDataFrame(rows, "id long, value string, times int").repartition(2, "id")
        tables.write_files(df, base, "id")
        got = readers.blobs(spark, base, content=True).collect()
        found = {r.path.split("id=")[1].split("/")[0].split("-")[0].removesuffix(".txt"): bytes(r.content).decode() for r in got}
        assert len(got) == len(want) and found.keys() == want.keys() and {r.mime_type for r in got} == {"text/plain"}
        assert all(sorted(found[k].split("\n")) == sorted("\n".join([*v, ""]).split("\n")) for k, v in want.items())
    assert not [p for p in tmp_path.rglob(".*") if not p.name.endswith(".crc")]
    named = spark.createDataFrame([("a/b=c", "v", 1)], "id string, value string, times int")
    tables.write_files(named, f"{tmp_path}/named", "id")
    assert "id=a%2Fb%3Dc" in readers.blobs(spark, f"{tmp_path}/named").first().path
    assert len(list((tmp_path / "named").rglob(".*.crc"))) == 1
    next((tmp_path / "named").rglob("*.txt")).write_bytes(b"w\n")
    with pytest.raises(Exception, match="(?i)checksum"):
        readers.blobs(spark, f"{tmp_path}/named", content=True).collect()
