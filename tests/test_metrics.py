"""Mergeable metrics and typed tables."""

import datetime as dt
import json
import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from pagemill.operators import metrics, typed

ATTEMPTS = "run_date date, task_id string, url string, ok boolean, duration long"


def test_classes_are_in_order_and_narrow(spark):
    rng = random.Random(1)
    values = [*range(300), *(rng.randrange(1 << rng.randrange(1, 62)) for _ in range(2000)), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "d long").withColumn("b", metrics.duration_class(F.col("d"))).withColumn("m", metrics.class_middle(F.col("b")))
    got = sorted((r.d, r.b, r.m) for r in df.collect())
    assert [b for _, b, _ in got] == sorted(b for _, b, _ in got)
    for d, b, m in got:
        assert (m == d if d < 128 else abs(m - d) <= d / 64) and b < 8000
    edge = spark.createDataFrame([(-5,), (None,)], "d long").select(metrics.duration_class(F.col("d")).alias("b")).collect()
    assert [r.b for r in edge] == [0, None]


def test_merged_metrics_equal_direct_ones(spark, tmp_path):
    rng = random.Random(2)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(day(rng.randrange(20)), f"t{rng.randrange(3)}", f"u{rng.randrange(30_000)}", rng.random() < 0.8, int(rng.lognormvariate(7, 2))) for _ in range(40_000)]
    base = str(tmp_path / "m")
    for k in range(4):  # the batches overlap in days
        part = spark.createDataFrame(rows[k::4], ATTEMPTS)
        metrics.write_metrics(part, base, k)
    metrics.write_metrics(spark.createDataFrame(rows[3::4], ATTEMPTS), base, 3)  # again: replaces itself
    for since, until in ((None, None), ("2024-01-05", "2024-01-11")):
        inside = [r for r in rows if (since is None or since <= r[0].isoformat() <= until)]
        got = {r.task_id: r for r in metrics.over_period(spark, base, since, until).collect()}
        for t in ("t0", "t1", "t2"):
            mine = [r for r in inside if r[1] == t]
            g = got[t]
            assert (g.attempts, g.succeeded) == (len(mine), sum(r[3] for r in mine))
            urls = len({r[2] for r in mine})
            assert abs(g.distinct_urls - urls) <= 4 * 1.04 / math.sqrt(1 << metrics.PRECISION) * urls + 1
            ordered = sorted(r[4] for r in mine)
            for p in (50, 90, 99):
                exact = ordered[-(-len(ordered) * p // 100) - 1]
                assert abs(g[f"p{p}"] - exact) <= exact / 64
    # The period's rows are picked in the scan.
    plan = metrics.over_period(spark, base, "2024-01-05", "2024-01-11")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(run_date" in plan


def test_metrics_of_nothing_and_nulls(spark, tmp_path):
    base = str(tmp_path / "m")
    rows = [(None, None, None, None, None), (dt.date(2024, 1, 1), None, "u", True, None), (dt.date(2024, 1, 1), "t", "u", None, -1)]
    metrics.write_metrics(spark.createDataFrame(rows, ATTEMPTS), base, 0)
    metrics.write_metrics(spark.createDataFrame([], ATTEMPTS), base, 1)
    got = {r.task_id: tuple(r)[1:] for r in metrics.over_period(spark, base).collect()}
    assert got == {None: (2, 1, 1, None, None, None), "t": (1, 0, 1, 0, 0, 0)}


def table_of(spark, values, **kw):
    rows = [(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    out = typed.typed_table(spark.createDataFrame(rows, "id long, record string"), **kw)
    return out, {r.id: r.asDict(recursive=True) for r in out.collect()}


def test_typed_table_widens_and_keeps_conflicts(spark):
    values = [
        {"n": 1, "price": 2, "tags": ["a"], "who": {"name": "x"}, "odd": "text", "none": None},
        {"n": 2, "price": 2.5, "tags": [], "who": {"name": "y", "age": 3}, "odd": 7},
        {"n": None, "odd": {"deep": [1]}, "mixed": [1, "a"]},
        "[1, 2]", "{broken", None, '"scalar"', "{}", '{"n": 1, "n": 2}',
    ]
    out, got = table_of(spark, values)
    kinds = dict(out.dtypes)
    assert kinds["n"] == "bigint" and kinds["price"].startswith("decimal") and kinds["tags"] == "array<string>" and kinds["none"] == "string"
    assert kinds["who"] == "struct<age:bigint,name:string>" and "odd" not in kinds and "mixed" not in kinds
    assert (got[0]["n"], got[0]["price"], got[1]["price"], got[0]["tags"]) == (1, Decimal(2), Decimal("2.5"), ["a"])
    assert got[1]["who"] == {"age": 3, "name": "y"} and got[0]["who"] == {"age": None, "name": "x"}
    assert [json.loads(got[i]["rest"]) for i in range(3)] == [{"odd": "text"}, {"odd": 7}, {"mixed": [1, "a"], "odd": {"deep": [1]}}]
    assert [got[i]["rest"] for i in range(3, 9)] == ["[1, 2]", "{broken", None, '"scalar"', None, '{"n": 1, "n": 2}']


def test_typed_table_names(spark):
    out, got = table_of(spark, [{"id": 5, "rest": "r", "Name": "a", "name": "b", "a b": 1, "it's": 2, "q`": 3}])
    assert got[0]["id"] == 0 and got[0]["id_"] == 5 and got[0]["rest_"] == "r" and got[0]["Name"] == "a" and got[0]["a b"] == 1
    assert got[0]["it's"] == 2 and got[0]["q`"] == 3 and json.loads(got[0]["rest"]) == {"name": "b"}


def test_typed_table_of_few_columns_or_none(spark):
    _, got = table_of(spark, [{"a": 1, "b": 2}, {"a": 3}], most=1)
    assert got[0]["a"] == 1 and json.loads(got[0]["rest"]) == {"b": 2} and got[1]["rest"] is None
    out, got = table_of(spark, [])
    assert out.columns == ["id", "rest"] and got == {}
