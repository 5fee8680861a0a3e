"""Records against the JSON Schema of their own task: schemas are rows, not code.

A schema becomes rules by path, a JSON pointer in which ``*`` stands for every item of an array (a key that is a star is
written ``~2``). A record becomes nodes (path, value) as deep as the rules go, and each node is held against the rules
of its path, all inside the row, by one small Arrow function over the text that Spark writes of the parsed record. The
only join is that of records with the rules of their task.

Checked: ``type`` (one or several), ``enum``, ``const``, ``format: date``, ``minItems``, ``maxItems``, ``minLength``,
``maxLength``, ``minimum``, ``maximum``, ``required`` and ``additionalProperties: false``, at any depth. Other keywords
are listed by ``unchecked``. A property with a null value counts as absent but for ``required``, which asks for the key;
a null item breaks the type of its array's items.

Text that is no JSON, records without task, and tasks without a usable schema have ``checked`` false and no violations.
"""

from __future__ import annotations

import calendar
import functools
import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import ship

RULES = "map<string,array<struct<keyword:string,argument:string>>>"
VIOLATIONS = "array<struct<path:string,keyword:string,argument:string>>"
#: Bytes of rules, over all tasks, up to which they are broadcast.
BROADCAST = 16 << 20
#: Parts of a task's records in the join beyond that.
SALTS = 32

_BOUNDS = ("minItems", "maxItems", "minLength", "maxLength", "minimum", "maximum")
_KNOWN = {"type", "enum", "const", "format", "required", "additionalProperties", "properties", "items", *_BOUNDS}
_SAID_ONLY = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _walk(schema: dict, path: str, rules: dict, unchecked: list) -> None:
    here = rules.setdefault(path, [])
    names = schema.get("type")
    if names:
        here.append(("type", names if isinstance(names, str) else ",".join(map(str, names))))
    if isinstance(schema.get("enum"), list):
        here.append(("enum", _compact(schema["enum"])))
    if "const" in schema:
        here.append(("enum", _compact([schema["const"]])))
    for keyword in _BOUNDS:
        bound = schema.get(keyword)
        if isinstance(bound, int | float) and not isinstance(bound, bool):
            here.append((keyword, _compact(bound)))
    here += [("required", str(key)) for key in schema.get("required") or ()]
    if schema.get("format") == "date":
        here.append(("format", "date"))
    elif "format" in schema:
        unchecked.append((path, "format"))
    if schema.get("additionalProperties") is False:
        here.append(("additionalProperties", "false"))
    elif isinstance(schema.get("additionalProperties"), dict):
        unchecked.append((path, "additionalProperties"))
    unchecked += [(path, k) for k in schema if k not in _KNOWN | _SAID_ONLY]
    for key, sub in (schema.get("properties") or {}).items():
        _walk(sub if isinstance(sub, dict) else {}, f"{path}/{_escaped(key)}", rules, unchecked)
    if isinstance(schema.get("items"), dict):
        _walk(schema["items"], f"{path}/*", rules, unchecked)


def _escaped(key: str) -> str:
    return "~2" if key == "*" else key.replace("~", "~0").replace("/", "~1")


def compiled(schema: str | None) -> dict | None:
    """Rules by path and the keywords that aren't checked; None for what is no JSON object or an empty one."""
    try:
        parsed = json.loads(schema or "")
    except ValueError:
        return None
    if not isinstance(parsed, dict) or not parsed:
        return None
    rules: dict[str, list] = {}
    unchecked: list = []
    _walk(parsed, "", rules, unchecked)
    return {"rules": rules, "unchecked": unchecked}


def compile_schemas(tasks: DataFrame) -> DataFrame:
    """``schema, rules, unchecked`` for each distinct schema of the tasks: few rows, however many tasks use them."""
    ship(tasks.sparkSession)
    made = F.udf(compiled, f"struct<rules:{RULES},unchecked:array<struct<path:string,keyword:string>>>")
    return tasks.select("schema").distinct().withColumn("c", made("schema")).select("schema", "c.rules", "c.unchecked")


def rule_table(tasks: DataFrame) -> DataFrame:
    """``schema, path, keyword, argument``: one row per rule of each distinct schema."""
    by_path = compile_schemas(tasks).select("schema", F.explode("rules").alias("path", "at"))
    return by_path.select("schema", "path", F.inline("at"))


def unchecked(tasks: DataFrame) -> DataFrame:
    """``schema, path, keyword``: what a schema asks for beyond the keywords that are checked."""
    return compile_schemas(tasks).select("schema", F.inline("unchecked"))


#: Sets of rules whose parsed form a worker keeps.
KEPT_RULES = 256
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:\r\n|\r|\n)?")
_WHOLE = re.compile(r"-?[0-9]+")


def _parsed(text: str):
    """JSON as Spark wrote it. A number is its text in a tuple, so that it equals only a number written alike."""
    number = lambda t: (t,)
    return json.loads(text, parse_int=number, parse_float=number, parse_constant=number)


@functools.lru_cache(KEPT_RULES)
def _rules(text: str) -> dict[str, list[tuple]]:
    """``path: [(keyword, argument, value)]`` from the JSON text of one task's rules."""
    out = {}
    for path, at in json.loads(text).items():
        out[path] = [(r["keyword"], r["argument"], _value(r)) for r in at]
    return out


def _value(rule: dict):
    keyword, argument = rule["keyword"], rule["argument"]
    if keyword == "type":
        return argument.split(",")
    if keyword == "enum":
        return None if rule.get("listed") is None else [None if x is None else [_parsed(x)] for x in rule["listed"]]
    if keyword in _BOUNDS:
        bound = float(argument)
        return math.inf if math.isnan(bound) else bound  # Spark orders it above all numbers
    return argument


def _kind(value) -> str:
    if isinstance(value, tuple):
        return "number"
    if value is None or isinstance(value, bool):
        return "null" if value is None else "boolean"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def _is_date(text: str) -> bool:
    m = _DATE.fullmatch(text)
    if not m:
        return False
    year, month, day = map(int, m.groups())
    return 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]


def _breaks(node, kind: str, path: str, rule: tuple, rules: dict) -> bool:
    keyword, argument, value = rule
    if keyword == "type":
        return kind not in value and not (kind == "number" and "integer" in value and _WHOLE.fullmatch(node[0]))
    if keyword == "enum":
        return value is not None and None not in value and [node] not in value
    if keyword == "format":
        return kind == "string" and not _is_date(node)
    if keyword == "required":
        return kind == "object" and argument not in node
    if keyword == "additionalProperties":
        return kind == "object" and any(f"{path}/{_escaped(k)}" not in rules for k in node)
    if keyword in ("minItems", "maxItems"):
        return kind == "array" and (len(node) < value if keyword == "minItems" else len(node) > value)
    if keyword in ("minLength", "maxLength"):
        return kind == "string" and (len(node) < value if keyword == "minLength" else len(node) > value)
    number = float(node[0]) if kind == "number" else None
    return number is not None and (number < value if keyword == "minimum" else number > value)


def _found(record: str, rules: dict) -> list[tuple[str, str, str]]:
    """What a record breaks: distinct (path, keyword, argument), sorted. Only what has rules or lies above such is entered."""
    found, todo = set(), [("", _parsed(record))]
    while todo:
        path, node = todo.pop()
        kind = _kind(node)
        if kind != "null" or path.endswith("/*"):  # else it counts as absent
            found.update((path, r[0], r[1]) for r in rules.get(path, ()) if _breaks(node, kind, path, r, rules))
        if kind == "object":
            todo += [(p, v) for k, v in node.items() if (p := f"{path}/{_escaped(k)}") in rules]
        elif kind == "array" and f"{path}/*" in rules:
            todo += [(f"{path}/*", v) for v in node]
    return sorted(found)


_VIOLATION = pa.list_(pa.struct([("path", pa.string()), ("keyword", pa.string()), ("argument", pa.string())]))


def _written(json: Column) -> Column:
    """A record in Spark's notation; null for what is no JSON. Keys that repeat stay, of which the reader takes the last."""
    repeats = F.when(F.startswith(F.ltrim(json), F.lit("{")), F.to_json(F.from_json(json, "map<string,variant>")))
    return F.coalesce(F.to_json(F.try_parse_json(json)), repeats)


def _held_against(record: Column, rules: Column) -> Column:
    """Violations of a record's JSON text, as Spark wrote it, by its task's rules; null without one of the two."""

    @F.arrow_udf(VIOLATIONS)
    def found(records: pa.Array, texts: pa.Array) -> pa.Array:
        pairs = zip(records, texts, strict=True)  # one text at a time is a Python object
        out = [_found(r.as_py(), _rules(t.as_py())) if r.is_valid and t.is_valid else None for r, t in pairs]
        return pa.array([None if v is None else [dict(zip(("path", "keyword", "argument"), x, strict=True)) for x in v] for v in out], _VIOLATION)

    return found.asNondeterministic()(record, rules)  # so that no filter on the violations is pushed below, to check again


def _rule_text(rules: Column) -> Column:
    """One task's rules as JSON text; the members of an enumeration are written as the records are."""

    def written(r: Column) -> Column:
        listed = F.transform(F.from_json(r["argument"], "array<variant>"), lambda v: F.to_json(v))
        return F.struct(r["keyword"].alias("keyword"), r["argument"].alias("argument"), F.when(r["keyword"] == "enum", listed).alias("listed"))

    return F.to_json(F.transform_values(rules, lambda _, at: F.transform(at, written)), {"ignoreNullFields": "false"})


def with_rules(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """``records`` with the ``rules`` of their task as JSON text (null if none).

    ``tasks``: ``task_id, schema``; of several schemas of one task the first in order of text counts. Rules are
    broadcast up to ``BROADCAST`` bytes in all; beyond that both sides are shuffled, each task's records in salted parts.
    """
    one = tasks.where("task_id is not null").groupBy("task_id").agg(F.min("schema").alias("schema"))
    rules = one.join(compile_schemas(one), "schema").select("task_id", _rule_text(F.col("rules")).alias("rules"))
    size = rules.agg(F.sum(F.length("rules"))).first()[0]
    if (size or 0) <= BROADCAST:
        return records.join(F.broadcast(rules), "task_id", "left")
    spread = records.withColumn("__part", F.pmod(F.xxhash64(*records.columns), F.lit(SALTS)))
    copies = rules.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return spread.join(copies, ["task_id", "__part"], "left").drop("__part")


def conformance(records: DataFrame, tasks: DataFrame, column: str = "record") -> DataFrame:
    """``records`` (with ``task_id`` and JSON text) and ``checked``, ``violations``: distinct (path, keyword, argument), sorted.

    Spark parses a record once and writes it in its own notation; the walk along the rules is one Arrow function.
    """
    taken = {"rules", "checked", "violations", "__part"} & {c.lower() for c in records.columns}
    if taken:
        raise ValueError(f"rename the columns {sorted(taken)}")
    found = with_rules(records, tasks).withColumn("violations", _held_against(_written(F.col(column)), F.col("rules")))
    checked, none = F.col("violations").isNotNull(), F.array().cast(VIOLATIONS)
    return found.select(*records.columns, checked.alias("checked"), F.coalesce("violations", none).alias("violations"))


def report(checked: DataFrame) -> DataFrame:
    """``task_id, path, keyword, argument, n``: how many records break each rule; narrow rows, combined before the shuffle."""
    return checked.select("task_id", F.inline("violations")).groupBy("task_id", "path", "keyword", "argument").agg(F.count(F.lit(1)).alias("n"))
