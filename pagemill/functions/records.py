"""Extracted records as JSON text: parsing, schema normalisation, status, conformance.

Records stay JSON strings between stages; a schema is a JSON string too, so each row may
carry its own.
"""

from __future__ import annotations

from json import dumps

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let

# Messages of the extraction stage.
NOT_AN_OBJECT = "Extracted data is not an object; cannot satisfy schema"
MISSING_FIELDS = "Missing required fields: "
PARSE_FAILED = "JSON parse failed: "
NO_CONFIG = "No LLM config provided"
NO_PROMPT = "No prompt_template provided"
NO_KEY = "Failed to create LLMConfig (likely missing API key)"
EMPTY_OUTPUT = "LLM returned empty/no extracted_content"
NO_HTML = "LLM extraction failed and no HTML content for fallback"
BOTH_FAILED = "Both primary and fallback extraction failed"
CRAWL_FAILED = "Crawl failed: "

RESULT = "struct<data:string,error:string>"


def kind(json: Column) -> Column:
    """object, array, string, number, boolean or null; SQL NULL for text that is no JSON."""
    return kind_of(F.try_parse_json(json))


def kind_of(node: Column) -> Column:
    """The same for a VARIANT value."""
    t = F.schema_of_variant(node)
    return (
        F.when(t.isNull(), F.lit(None).cast("string"))
        .when(F.startswith(t, F.lit("OBJECT")), F.lit("object"))
        .when(F.startswith(t, F.lit("ARRAY")), F.lit("array"))
        .when(t == "STRING", F.lit("string"))
        .when(t == "BOOLEAN", F.lit("boolean"))
        .when(t == "VOID", F.lit("null"))
        .otherwise(F.lit("number"))
    )


def _is_object(json: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(json), F.lit("{")), F.lit(False)) & F.try_parse_json(json).isNotNull()


def compact(json: Column) -> Column:
    return F.to_json(F.try_parse_json(json))


def schema_properties(schema: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(schema, "$.properties")), F.array().cast("array<string>"))


def schema_required(schema: Column) -> Column:
    return F.coalesce(
        F.from_json(F.get_json_object(schema, "$.required"), "array<string>"), F.array().cast("array<string>")
    )


def _failure(message: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("data"), message.alias("error"))


def last_wins(json: Column) -> Column:
    """An object whose keys repeat, with the last value of each key; other text as it is."""
    entries = F.map_entries(F.from_json(json, "map<string,variant>"))
    once = let(entries, lambda e: F.map_from_entries(F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"]))))
    repeats = F.try_parse_json(json).isNull() & F.startswith(F.ltrim(json), F.lit("{")) & entries.isNotNull()
    return F.when(repeats, F.to_json(once)).otherwise(json)


def normalize(json: Column, schema: Column) -> Column:
    """struct<data,error>: keep the keys the schema lists, report the required ones that are absent.

    Presence counts, a null value passes. Without a usable schema any value passes as it is. Of repeated keys the last
    counts. Text that is no JSON gives an error.
    """
    return let(last_wins(json), lambda j: _normalize(j, schema))


def _normalize(json: Column, schema: Column) -> Column:
    fields = F.from_json(json, "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: F.array_contains(schema_properties(schema), k))

    def check(m: Column) -> Column:
        missing = F.filter(schema_required(schema), lambda k: ~F.array_contains(F.map_keys(m), k))
        return F.when(
            F.size(missing) > 0, _failure(F.concat(F.lit(MISSING_FIELDS), F.array_join(missing, ", ")))
        ).otherwise(F.struct(F.to_json(m).alias("data"), F.lit(None).cast("string").alias("error")))

    no_schema = schema.isNull() | ~_is_object(schema) | (F.coalesce(F.size(F.json_object_keys(schema)), F.lit(0)) == 0)
    cause = F.when(F.coalesce(F.btrim(json), F.lit("")) == "", F.lit("no content")).otherwise(F.lit("not a JSON document"))
    return (
        F.when(F.try_parse_json(json).isNull(), _failure(F.concat(F.lit(PARSE_FAILED), cause)))
        .when(no_schema, F.struct(compact(json).alias("data"), F.lit(None).cast("string").alias("error")))
        .when(~_is_object(json), _failure(F.lit(NOT_AN_OBJECT)))
        .otherwise(let(kept, check))
    )


def wrap_results(json: Column) -> Column:
    """A list of results as one record: none gives NULL, one gives itself, many go under ``items``."""
    items = F.from_json(json, "array<variant>")
    one = F.to_json(F.variant_get(F.try_parse_json(json), "$[0]", "variant"))
    many = F.concat(F.lit('{"items":'), compact(json), F.lit("}"))
    is_list = F.startswith(F.ltrim(json), F.lit("[")) & F.try_parse_json(json).isNotNull()
    return F.when(is_list & (F.size(items) == 1), one).when(is_list & (F.size(items) > 1), many)


def truthy(json: Column) -> Column:
    """False for NULL and for empty or zero JSON values."""
    return F.coalesce(
        ~compact(json).isin("{}", "[]", '""', "0", "0.0", "false", "null"), F.lit(False)
    )


def size_chars(json: Column) -> Column:
    """Characters of the compact serialised form."""
    return F.length(compact(json)).cast("bigint")


def key_preview(json: Column, n: int = 10) -> Column:
    return F.slice(F.json_object_keys(json), 1, n)


def stage2(
    *, has_config: Column, prompt: Column, has_key: Column, crawl_ok: Column, crawl_error: Column,
    primary: Column, fallback: Column, fallback_enabled: Column, has_html: Column, schema: Column,
) -> Column:
    """Outcome of the extraction stage for one page.

    struct<structured_data, enabled, success, error, output_size_bytes, fallback_used>. ``primary``
    is the raw first answer, ``fallback`` the JSON list of the second attempt.
    """
    has_prompt = F.coalesce(prompt, F.lit("")) != ""
    enabled = has_config & has_prompt & has_key
    config_error = (
        F.when(~has_config, F.lit(NO_CONFIG)).when(~has_prompt, F.lit(NO_PROMPT)).when(~has_key, F.lit(NO_KEY))
    )

    def outcome(data, success, error, used) -> Column:
        text = data if data is not None else F.lit(None).cast("string")
        err = error if error is not None else F.lit(None).cast("string")
        return F.struct(
            text.alias("structured_data"),
            enabled.alias("enabled"),
            F.lit(success).alias("success"),
            err.alias("error"),
            (F.length(text) if success else F.lit(None)).cast("bigint").alias("output_size_bytes"),
            F.lit(used).alias("fallback_used"),
        )

    def accepted(result: Column) -> Column:
        return F.when(result["error"].isNotNull(), outcome(None, False, result["error"], False)).otherwise(
            outcome(result["data"], True, None, True)
        )

    def second(first_error: Column) -> Column:
        judged = let(
            wrap_results(fallback),
            lambda w: F.when(~truthy(w), outcome(None, False, F.lit(BOTH_FAILED), False)).otherwise(
                let(normalize(w, schema), accepted)
            ),
        )
        return (
            F.when(~fallback_enabled, outcome(None, False, first_error, False))
            .when(~has_html, outcome(None, False, F.lit(NO_HTML), False))
            .otherwise(judged)
        )

    attempt = F.when(F.coalesce(primary, F.lit("")) == "", _failure(F.lit(EMPTY_OUTPUT))).otherwise(
        normalize(primary, schema)
    )
    return (
        F.when(~crawl_ok, outcome(None, False, F.concat(F.lit(CRAWL_FAILED), F.coalesce(crawl_error, F.lit(""))), False))
        .when(~enabled, outcome(None, False, config_error, False))
        .otherwise(
            let(
                attempt,
                lambda r: F.when(r["error"].isNull(), outcome(r["data"], True, None, False)).otherwise(second(r["error"])),
            )
        )
    )


def _violation(cond: Column, path: str, rule: str) -> Column:
    return F.when(cond, F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule")))


def _is_type(node: Column, want: str) -> Column:
    """Whether a VARIANT has a JSON Schema type."""
    if want == "integer":
        return (kind_of(node) == "number") & F.rlike(F.to_json(node), F.lit(r"^-?[0-9]+$"))
    return kind_of(node) == want


def _literal(value) -> Column:
    """A literal as compact JSON, written by the same writer as the records."""
    return F.to_json(F.parse_json(F.lit(dumps(value, ensure_ascii=False))))


_FIELDS = "map<string,variant>"


def _wrong(key: str, want: str):
    def test(fields: Column) -> Column:
        return let(F.try_element_at(fields, F.lit(key)), lambda v: F.coalesce((F.to_json(v) != "null") & ~_is_type(v, want), F.lit(False)))

    return test


def _lacks(key: str):
    return lambda fields: ~F.coalesce(F.map_contains_key(fields, key), F.lit(False))


def _broken(node: Column, path: str, spec: dict) -> list[Column]:
    """Rules of one property that its VARIANT value breaks; an absent or null value breaks none."""
    found = []
    as_json = F.to_json(node)
    present = F.coalesce(as_json != "null", F.lit(False))
    want = spec.get("type")
    if want:
        found.append(_violation(present & ~_is_type(node, want), path, f"type:{want}"))
    if "enum" in spec:
        found.append(_violation(present & ~as_json.isin(*[_literal(v) for v in spec["enum"]]), path, "enum"))
    if spec.get("format") == "date":
        value = F.try_variant_get(node, "$", "string")
        strict = F.rlike(value, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")) & value.try_cast("date").isNotNull()
        found.append(_violation(present & ~F.coalesce(strict, F.lit(False)), path, "format:date"))
    if want == "array":
        items = F.try_variant_get(node, "$", "array<variant>")
        if "minItems" in spec:
            found.append(_violation(F.size(items) < spec["minItems"], path, "minItems"))
        if "maxItems" in spec:
            found.append(_violation(F.size(items) > spec["maxItems"], path, "maxItems"))
        inner = spec.get("items", {})
        if inner.get("type"):
            found.append(_violation(F.exists(items, lambda x: ~F.coalesce(_is_type(x, inner["type"]), F.lit(False))), f"{path}[]", f"type:{inner['type']}"))
        objects = F.transform(items, lambda x: F.from_json(F.to_json(x), _FIELDS))
        for key in inner.get("required", []):
            found.append(_violation(F.exists(objects, _lacks(key)), f"{path}[]", f"required:{key}"))
        for key, sub in inner.get("properties", {}).items():
            if sub.get("type"):
                found.append(_violation(F.exists(objects, _wrong(key, sub["type"])), f"{path}[].{key}", f"type:{sub['type']}"))
    return found


def violations(json: Column, schema: dict) -> Column:
    """Array of (path, rule) for keywords that normalisation does not enforce.

    Checked: type, enum of any JSON values, format date, minItems, maxItems, and for array items their type, required
    keys and property types. An absent or null field breaks no rule; a record is parsed once.
    """
    none = F.array().cast("array<struct<path:string,rule:string>>")
    properties = schema.get("properties", {})
    if not properties:
        return none

    def of(name: str, spec: dict):
        def rules(node: Column) -> Column:
            broken = _broken(node, name, spec)
            return F.array_compact(F.array(*broken)) if broken else none

        return lambda fields: let(F.try_element_at(fields, F.lit(name)), rules)

    def check(fields: Column) -> Column:
        return F.coalesce(F.flatten(F.array(*[of(name, spec)(fields) for name, spec in properties.items()])), none)

    return let(F.from_json(last_wins(json), _FIELDS), check)


_SCALARS = {"string": "STRING", "integer": "BIGINT", "number": "DOUBLE", "boolean": "BOOLEAN"}


def schema_ddl(schema: dict) -> str:
    """Spark type of the records of one JSON Schema; free-form objects stay VARIANT."""
    if schema.get("type") == "object" and schema.get("properties"):
        return "STRUCT<" + ", ".join(f"`{k}`: {schema_ddl(v)}" for k, v in schema["properties"].items()) + ">"
    if schema.get("type") == "array":
        return f"ARRAY<{schema_ddl(schema.get('items', {}))}>"
    if schema.get("format") == "date":
        return "DATE"
    return _SCALARS.get(schema.get("type"), "VARIANT")


def typed(json: Column, schema: dict) -> Column:
    """Record as a typed struct of its schema."""
    return F.from_json(json, schema_ddl(schema))
