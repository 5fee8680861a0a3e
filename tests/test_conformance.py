"""Schemas as data: rules of each task's schema against records of any shape."""

import json

import pytest
from pagemill.operators import conformance

NESTED = {
    "type": "object", "title": "said only", "pattern": "x",
    "properties": {
        "a/b": {"type": "integer"}, "*": {"const": 1}, "gone": {"type": "string"},
        "rows": {"type": "array", "minItems": 1, "items": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"enum": [1, None, {"z": [2]}]}}}}},
        "name": {"type": ["string", "null"], "maxLength": 3}, "day": {"format": "date"}, "n": {"minimum": -1.5, "maximum": 2},
    },
    "additionalProperties": False,
}
TASKS = [("nested", json.dumps(NESTED)), ("list", '{"type":"array"}'), ("bad", "{no"), ("empty", "{}"), ("null", None), (None, '{"type":"array"}'), ("twice", '{"type":"array"}'), ("twice", '{"type":"object"}')]
RECORDS = [
    ("nested", '{"rows":[[{"k":1}]],"name":null,"gone":null}', []),
    ("nested", '{"a/b":1.5,"*":2,"x":1}', [" additionalProperties false", "/a~1b type integer", "/~2 enum [1]"]),
    ("nested", '{"rows":[]}', ["/rows minItems 1"]),
    ("nested", '{"rows":[[{"k":{"z":[2]}},{"k":3},{}],[7,null],5]}', ['/rows/* type array', '/rows/*/* required k', '/rows/*/* type object', '/rows/*/*/k enum [1,null,{"z":[2]}]']),
    ("nested", '{"name":"long","day":"2024-13-01","n":2.5}', ["/day format date", "/n maximum 2", "/name maxLength 3"]),
    ("nested", '{"name":"a","name":7,"day":7,"n":-2}', ["/n minimum -1.5", "/name type string,null"]),
    ("nested", "[]", [" type object"]), ("nested", "{cut", None), ("nested", None, None), ("nested", "", None),
    ("list", "[1]", []), ("list", "{}", [" type array"]), ("bad", "{}", None), ("empty", "{}", None), ("null", "{}", None), (None, "{}", None), ("unknown", "{}", None),
    ("twice", "{}", [" type array"]),
]


@pytest.mark.parametrize("broadcast", [conformance.BROADCAST, -1])
def test_conformance(spark, monkeypatch, broadcast):
    monkeypatch.setattr(conformance, "BROADCAST", broadcast)
    tasks = spark.createDataFrame(TASKS, "task_id string, schema string")
    records = spark.createDataFrame([(i, t, r, "x") for i, (t, r, _) in enumerate(RECORDS)], "id long, task_id string, record string, path string")
    got = conformance.conformance(records, tasks)
    assert got.columns == ["id", "task_id", "record", "path", "checked", "violations"]
    for r in got.collect():
        want = RECORDS[r["id"]][2]
        assert r.checked == (want is not None)
        assert [f"{v.path} {v.keyword} {v.argument}" for v in r.violations] == (want or []), RECORDS[r["id"]]
    assert got.count() == len(RECORDS)
    counted = {(r.task_id, r.path, r.keyword): r.n for r in conformance.report(got).collect()}
    assert counted["nested", "/rows/*", "type"] == 1 and counted["list", "", "type"] == 1


def test_rules_and_empty_tables(spark):
    tasks = spark.createDataFrame(TASKS, "task_id string, schema string")
    rules = {(r.path, r.keyword, r.argument) for r in conformance.rule_table(tasks).collect() if r.schema == TASKS[0][1]}
    assert ("/rows/*/*", "required", "k") in rules and ("/name", "type", "string,null") in rules
    assert [(r.path, r.keyword) for r in conformance.unchecked(tasks).collect()] == [("", "pattern")]
    none = spark.createDataFrame([], "task_id string, record string")
    assert conformance.conformance(none, tasks).count() == 0
    some = spark.createDataFrame([("a", "{}")], none.schema)
    assert [r.checked for r in conformance.conformance(some, tasks.limit(0)).collect()] == [False]
    with pytest.raises(ValueError):
        conformance.conformance(some.withColumnRenamed("task_id", "Rules"), tasks)


def test_report_checks_each_record_once(spark, sf_dir):
    """No filter on the violations is pushed below their making, with a check of its own."""
    from pagemill.plans import records

    plan = records.task_conformance_report(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [found(") == 1 and "variant_get" not in plan.lower()
