import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions import records as R
from pagemill.functions import values as V

SCHEMA = '{"properties":{"title":{"type":"string"}},"required":["title"]}'


@pytest.mark.parametrize(
    "raw,schema,data,error",
    [
        ('{"title":"Red door","shade":7}', SCHEMA, '{"title":"Red door"}', None),
        ('{"shade":7}', SCHEMA, None, "Missing required fields: title"),
        ('{"title":1,"shade":7,"title":2}', SCHEMA, '{"title":2}', None),
        ('{"title":null}', SCHEMA, '{"title":null}', None),
        ("[1]", SCHEMA, None, R.NOT_AN_OBJECT), ("3", SCHEMA, None, R.NOT_AN_OBJECT), ("null", SCHEMA, None, R.NOT_AN_OBJECT),
        ("{}", SCHEMA, None, "Missing required fields: title"),
        ("{}", '{"required":["b","a"]}', None, "Missing required fields: b, a"),
        ('{"title":{"a":[1,2.5]}}', SCHEMA, '{"title":{"a":[1,2.5]}}', None),
        ("[1]", None, "[1]", None), ("[1]", "{}", "[1]", None), ('{"a":1}', '{"type":"object"}', "{}", None), ("[2]", "[1]", "[2]", None),
    ],
)
def test_normalize(spark, raw, schema, data, error):
    r = spark.createDataFrame([(raw, schema)], "j string, s string").select(R.normalize(F.col("j"), F.col("s")).alias("n")).first().n
    assert (r.data, r.error) == (data, error)


def test_parse_failure(one):
    assert one("{bad", R.normalize(F.col("t"), F.lit(None).cast("string")))["error"].startswith("JSON parse failed: ")
    assert one(" ", R.normalize(F.col("t"), F.lit(None).cast("string")))["error"] == "JSON parse failed: no content"
    assert one('{"a":1,"a":2}', R.normalize(F.col("t"), F.lit(None).cast("string")))["data"] == '{"a":2}'


DEFAULT = dict(cfg=True, prompt="p", key=True, ok=True, err=None, primary='{"title":"x","y":1}', fallback=None, on=True, html=True, schema=SCHEMA)
CASES = [
    ({}, ('{"title":"x"}', True, True, None, False)),
    (dict(cfg=False), (None, False, False, R.NO_CONFIG, False)),
    (dict(cfg=False, prompt=None), (None, False, False, R.NO_CONFIG, False)),
    (dict(prompt=""), (None, False, False, R.NO_PROMPT, False)),
    (dict(key=False), (None, False, False, R.NO_KEY, False)),
    (dict(ok=False, err="boom"), (None, True, False, "Crawl failed: boom", False)),
    (dict(ok=False, err="boom", cfg=False), (None, False, False, "Crawl failed: boom", False)),
    (dict(primary=None, on=False), (None, True, False, R.EMPTY_OUTPUT, False)),
    (dict(primary="", on=False), (None, True, False, R.EMPTY_OUTPUT, False)),
    (dict(primary='[{"title":"x"}]', on=False), (None, True, False, R.NOT_AN_OBJECT, False)),
    (dict(primary="{}", on=False), (None, True, False, "Missing required fields: title", False)),
    (dict(primary="{}", html=False), (None, True, False, R.NO_HTML, False)),
    (dict(primary="{}", fallback="[]"), (None, True, False, R.BOTH_FAILED, False)),
    (dict(primary="{}", fallback="[{}]"), (None, True, False, R.BOTH_FAILED, False)),
    (dict(primary="{}", fallback=None), (None, True, False, R.BOTH_FAILED, False)),
    (dict(primary="{}", fallback='[{"a":1}]'), (None, True, False, "Missing required fields: title", False)),
    (dict(primary="{}", fallback='[{"title":"f","z":1}]'), ('{"title":"f"}', True, True, None, True)),
    (dict(primary="{}", fallback='[{"title":"f"},{"title":"g"}]'), (None, True, False, "Missing required fields: title", False)),
    (dict(primary="{bad", fallback='[{"a":1},{"b":2}]', schema=None), ('{"items":[{"a":1},{"b":2}]}', True, True, None, True)),
    (dict(primary="[1,2]", schema=None), ("[1,2]", True, True, None, False)),
]


def test_stage2_truth_table(spark):
    rows = [tuple({**DEFAULT, **change}.values()) for change, _ in CASES]
    df = spark.createDataFrame(rows, "cfg boolean, prompt string, key boolean, ok boolean, err string, primary string, fallback string, on boolean, html boolean, schema string")
    c = F.col
    s = R.stage2(
        has_config=c("cfg"), prompt=c("prompt"), has_key=c("key"), crawl_ok=c("ok"), crawl_error=c("err"), primary=c("primary"),
        fallback=c("fallback"), fallback_enabled=c("on"), has_html=c("html"), schema=c("schema"),
    )
    for (change, want), row in zip(CASES, df.select(s.alias("s")).collect()):
        got = row.s
        assert (got.structured_data, got.enabled, got.success, got.error, got.fallback_used) == want, change
        assert got.output_size_bytes == (len(want[0]) if want[0] else None)


def test_bad_json_error_is_kept(spark):
    df = spark.range(1)
    n = F.lit(None).cast("string")
    s = R.stage2(
        has_config=F.lit(True), prompt=F.lit("p"), has_key=F.lit(True), crawl_ok=F.lit(True), crawl_error=n, primary=F.lit("{bad"),
        fallback=n, fallback_enabled=F.lit(False), has_html=F.lit(True), schema=n,
    )
    assert df.select(s.alias("s")).first().s.error.startswith("JSON parse failed: ")


def test_violations_and_typing(one):
    schema = {"type": "object", "properties": {
        "kw": {"type": "array", "items": {"type": "string"}, "minItems": 3, "maxItems": 5}, "d": {"type": "string", "format": "date"},
        "e": {"type": "string", "enum": ["有货", "缺货"]}, "items": {"type": "array", "items": {"type": "object", "required": ["u"]}},
        "n": {"type": "integer"}, "free": {"type": "object"}}}
    bad = '{"kw":["a"],"d":"2024-13-01","e":"y","items":[{"u":1},{"z":2}],"n":1.5,"free":3}'
    got = {(v.path, v.rule) for v in one(bad, R.violations(F.col("t"), schema))}
    assert got == {("kw", "minItems"), ("d", "format:date"), ("e", "enum"), ("items[]", "required:u"), ("n", "type:integer"), ("free", "type:object")}
    good = '{"kw":["a","b","c"],"d":"2024-01-05","e":"有货","items":[{"u":1}],"n":3,"free":{"a":1}}'
    odd = {"properties": {"a.b": {"type": "integer"}, "e": {"enum": [1, {"x": [2]}, "q"]}, "l": {"type": "array", "items": {"properties": {"k": {"type": "string"}}}}}}
    assert one('{"a.b":1,"e":{"x":[2]},"l":[{"k":"v"},{}]}', R.violations(F.col("t"), odd)) == []
    found = one('{"a.b":"1","e":"1","l":[{"k":3}]}', R.violations(F.col("t"), odd))
    assert [tuple(v) for v in found] == [("a.b", "type:integer"), ("e", "enum"), ("l[].k", "type:string")]
    assert one("no json", R.violations(F.col("t"), odd)) == []
    assert one(good, R.violations(F.col("t"), schema)) == [] and one('{"d":null}', R.violations(F.col("t"), schema)) == []
    t = one(good, R.typed(F.col("t"), schema))
    assert (t.kw, str(t.d), t.n) == (["a", "b", "c"], "2024-01-05", 3) and json.loads(t.free.toJson()) == {"a": 1}


def test_key_preview(one):
    wide = json.dumps({f"k{i}": i for i in range(14)})
    assert one(wide, R.key_preview(F.col("t"))) == [f"k{i}" for i in range(10)]


@pytest.mark.parametrize(
    "text,want",
    [("2024-1-5", "2024-01-05"), ("2024/01/05", "2024-01-05"), ("2024年1月5日", "2024-01-05"), ("Jan 5, 2024", "2024-01-05"),
     ("5 March 2024", "2024-03-05"), ("2024-01-05T10:11:12Z", "2024-01-05"), ("2024-13-01", None), ("2023-02-30", None), ("", None), (None, None)],
)
def test_dates(one, text, want):
    assert one(text, V.to_iso_date(F.col("t"))) == want


@pytest.mark.parametrize("text,want", [("¥1234.5", "¥1,234.50"), ("$1,234.56", "$1,234.56"), ("1234 元", "¥1,234.00"), ("free", None), (None, None)])
def test_prices(one, text, want):
    assert one(text, V.price_text(F.col("t"))) == want


def test_tidy_and_author(one):
    assert one("<b>a</b>　，\n b！", V.tidy(F.col("t"))) == "a , b!"
    assert one(" ", V.author_or_unknown(F.col("t"), F.lit("en"))) == "Unknown"
    assert one(None, V.author_or_unknown(F.col("t"), F.lit("zh-CN"))) == "未知"
    assert one(" 张 三 ", V.author_or_unknown(F.col("t"), F.lit("zh"))) == "张 三"
