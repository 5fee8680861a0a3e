"""Streams with keyed state: new URLs, and runs that end too late or never."""

import datetime as dt

import pytest

from pagemill.streaming import jobs


@pytest.fixture
def dedup(spark, tmp_path):
    inbox, out, cp = (str(tmp_path / n) for n in ("inbox", "out", "cp"))

    def put(rows):
        jobs.new_urls(spark.createDataFrame(rows, "url string, deduplication_enabled boolean, seq long").coalesce(1), inbox)

    def run(**kw):
        return jobs.dedup_keyed(spark, inbox, out, cp, partitions=4, **kw)

    def passed():
        return sorted((r.url or "", r.seq) for r in spark.read.parquet(out).collect())

    return put, run, passed, inbox


def test_keyed_dedup_over_restarts(spark, dedup):
    put, run, passed, inbox = dedup
    jobs.known_urls(spark.createDataFrame([("k",), ("k",), (None,)], "url string"), inbox)
    run()
    assert passed() == []
    put([("k", True, 1), ("a", True, 2), ("b", None, 3), ("k", False, 4), (None, True, 5)])
    run()
    first = [("", 5), ("a", 2), ("b", 3), ("k", 4)]
    assert passed() == first
    run()
    assert passed() == first  # nothing new, nothing twice
    put([("a", True, 6), ("k", True, 7), ("c", True, 8), ("a", False, 9), (None, True, 10)])
    run()
    assert passed() == sorted([*first, ("c", 8), ("a", 9)])


def test_keyed_dedup_same_batch_keeps_one(dedup):
    put, run, passed, _ = dedup
    put([("a", True, i) for i in range(50)] + [("b", True, 99)])
    run()
    assert [u for u, _ in passed()] == ["a", "b"]


def test_keyed_dedup_batches_read_their_own_rows(dedup):
    put, run, passed, _ = dedup
    for i in range(6):
        put([(f"u{i}-{j}", True, j) for j in range(20)] + [(f"u0-{j}", True, j) for j in range(20)])
    got = [p for p in run(files=1) if p["rows"]]
    # Both branches read the file, so each row is counted twice at most; nothing grows with the batch but the keys held.
    assert len(got) == 6 and len({p["rows"] for p in got}) == 1
    assert got[-1]["keys"] == 120 == len(passed())


def test_keyed_dedup_leaves_the_session_alone(spark, dedup):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    put, run, _, _ = dedup
    put([("a", True, 1)])
    run()
    assert spark.conf.get(key) == before and spark.conf.get("spark.sql.shuffle.partitions") == "8"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture
def watch(spark, tmp_path):
    starts, ends, out, cp = (str(tmp_path / n) for n in ("starts", "ends", "out", "cp"))

    def sit(s, e):
        s = [(r, "t", at(m)) for r, m in s]
        e = [(r, at(m), "completed") for r, m in e]
        spark.createDataFrame(s, jobs._STARTS).coalesce(1).write.mode("append").parquet(starts)
        spark.createDataFrame(e, jobs._ENDS).coalesce(1).write.mode("append").parquet(ends)
        return sum(p["late"] for p in jobs.watch_runs(spark, starts, ends, out, cp, "60 MINUTES", "2 hours", 4))

    def states():
        return {r.run_id: (r.status, r.completed_at) for r in spark.read.parquet(out).collect()}

    return sit, states


def test_runs_that_end_late_or_never(watch):
    sit, states = watch
    assert sit([("ok", 0), ("slow", 0), ("lost", 5), ("edge", 10), ("open", 500)], [("ok", 30), ("slow", 61), ("edge", 70), ("stray", 20), ("early", 500)]) == 0
    # 500 less two hours is 380: what started before 320 without an end is an error, "open" is not known yet.
    assert states() == {"ok": ("completed", at(30)), "edge": ("completed", at(70)), "slow": ("error", None), "lost": ("error", None)}
    # A start and an end behind the watermark come too late and are counted; "open" ends in a later sitting.
    assert sit([("tardy", 100), ("new", 900)], [("lost", 40), ("open", 540), ("end", 900)]) == 2
    got = states()
    assert got["open"] == ("completed", at(540)) and got["lost"] == ("error", None)
    assert "tardy" not in got and "new" not in got and "stray" not in got
    sit([("x", 2000)], [("y", 2000)])
    assert states()["new"] == ("error", None)


def test_an_end_before_its_start_is_no_end(watch):
    sit, states = watch
    sit([("a", 100), ("z", 900)], [("a", 99), ("z", 900)])
    assert states()["a"] == ("error", None)


def test_runs_without_an_id_or_with_the_same_one(spark, watch, tmp_path):
    sit, _ = watch
    sit([("a", 0), ("a", 1), (None, 2), ("z", 900)], [("a", 10), (None, 12), ("z", 900)])
    got = sorted(((r.run_id or "", r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("", "error"), ("a", "completed"), ("a", "completed"), ("z", "completed")]
