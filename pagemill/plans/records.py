"""Queries over JSON records: normalisation, conformance, typing, extraction status."""

from __future__ import annotations

from json import dumps

from pyspark.sql import functions as F

from pagemill.functions import page, records, values
from pagemill.operators import conformance, extract, pages as ops, typed
from pagemill.plans import sqltext as q
from pagemill.plans.inputs import heavy, table, text

TITLE_SCHEMA = '{"type":"object","properties":{"title":{"type":"string"},"url":{"type":"string"}},"required":["title","url"]}'
NOTICE_SCHEMA = {
    "type": "object",
    "properties": {
        "headline": {"type": "string"},
        "printed.on": {"type": "string", "format": "date"},
        "topics": {"type": "array", "items": {"type": "string"}, "minItems": 3, "maxItems": 4},
        "grade": {"enum": [1, 2.5, "open", {"a": [1]}]},
        "size": {"type": "integer"},
        "parts": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}},
    },
}
_LINE = {"no": {"type": "integer"}, "qty": {"type": "number"}, "flag": {"type": "string"}, "dates": {"type": "object"}}
#: The schema of each task, which is an order's priority here.
ORDER_SCHEMAS = {
    "1-URGENT": {
        "type": "object", "required": ["id", "lines"],
        "properties": {"lines": {"type": "array", "minItems": 3, "items": {"properties": {"qty": {"maximum": 40}}}}},
    },
    "2-HIGH": {
        "properties": {
            "status": {"enum": ["F", "O"]}, "customer": {"type": "object", "required": ["note"]},
            "lines": {"items": {"type": "object", "required": ["rest"]}},
        },
    },
    "3-MEDIUM": {
        "properties": {
            "lines": {
                "maxItems": 5,
                "items": {"properties": {"flag": {"enum": ["A", "N"]}, "dates": {"properties": {"ship": {"type": "string", "format": "date"}}}}},
            },
        },
    },
    "4-NOT SPECIFIED": {"properties": {"placed": {"format": "date"}, "total": {"type": "integer"}, "id": {"minimum": 100}}},
    "5-LOW": {
        "properties": {
            "status": {"type": ["string", "null"]}, "customer": {"properties": {"note": {"type": "string", "minLength": 4}, "key": {"type": "string"}}},
            "lines": {"items": {"properties": _LINE, "additionalProperties": False}},
        },
    },
}
PRODUCT_SCHEMA = {
    "type": "object",
    "properties": {
        "name": {"type": "string"}, "size": {"type": "integer"}, "price": {"type": "number"},
        "listed": {"type": "string", "format": "date"}, "tags": {"type": "array", "items": {"type": "string"}},
    },
}


def page_record_normalized(spark, sf_dir):
    """Records of every shape, one per page, against a per-row schema."""
    p = ops.with_canon(heavy(spark, sf_dir, "pages")).select("page_id", "url", page.title(F.col("canon")).alias("title"))
    m = F.col("page_id") % 6
    full = F.to_json(F.struct("title", "url", F.lit(False).alias("error")))
    raw = (
        F.when(m == 1, F.to_json(F.struct("url")))
        .when(m == 2, text("[", full, "]"))
        .when(m == 3, text("{not json ", F.col("page_id")))
        .when(m == 5, text('{"title":null,"url":"', F.col("url"), '","x":{"y":[1,2]}}'))
        .otherwise(full)
    )
    schema = F.when(m != 4, F.lit(TITLE_SCHEMA))
    staged = p.withColumn("raw", raw).withColumn("schema", schema)
    return staged.select("page_id", records.normalize(F.col("raw"), F.col("schema")).alias("n")).select("page_id", "n.data", "n.error")


def page_record_conformance(spark, sf_dir):
    """Records of the pages' own titles with shares of broken fields, against a schema."""
    i = F.col("page_id")
    p = ops.with_canon(heavy(spark, sf_dir, "pages")).select("page_id", F.coalesce(page.title(F.col("canon")), F.lit("")).alias("title"))
    json = text(
        '{"headline":', F.when(i % 7 == 0, F.lit("12")).otherwise(F.to_json(F.array("title")).substr(F.lit(2), F.length(F.to_json(F.array("title"))) - 2)),
        ',"printed.on":', F.when(i % 5 == 0, F.lit('"2024-13-01"')).when(i % 5 == 1, F.lit('"2024-1-5"')).when(i % 5 == 2, F.lit("null")).otherwise(F.lit('"2024-01-05"')),
        ',"topics":', F.to_json(F.split("title", " ")),
        ',"grade":', F.when(i % 6 == 0, F.lit('"1"')).when(i % 6 == 1, F.lit("2.5")).when(i % 6 == 2, F.lit('{"a":[1]}')).when(i % 6 == 3, F.lit("[1]")).otherwise(F.lit('"open"')),
        ',"size":3,"size":', F.when(i % 2 == 0, F.length("title").cast("string")).otherwise(F.lit("3.5")),
        ',"parts":[{"n":1}', F.when(i % 8 == 0, F.lit(',{"m":"b"}')).when(i % 8 == 1, F.lit(',{"n":"b"}')).when(i % 8 == 2, F.lit(",7")).otherwise(F.lit("")), "]}",
    )
    v = p.select("page_id", records.violations(json, NOTICE_SCHEMA).alias("v"))
    return v.select(
        "page_id", F.size("v").alias("n_violations"),
        F.array_join(F.transform("v", lambda x: F.concat_ws(" ", x["path"], x["rule"])), "; ").alias("violations"),
    )


def _order_records(spark, sf_dir):
    """A record per order with its lines inside; the order's priority is the task that made it."""
    shown = F.when(F.col("l_linenumber") % 2 == 1, F.date_format("l_shipdate", "yyyy/MM/dd")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    line = F.struct(
        F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"),
        F.struct(shown.alias("ship")).alias("dates"), F.when(F.col("l_tax") == 0, F.lit("none")).alias("rest"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    # A number of partitions that is given isn't coalesced by bytes: the records are small and the work on them isn't.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    o = table(spark, sf_dir, "orders").repartition(tasks, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    whole = F.to_json(F.struct(
        k.alias("id"), F.col("o_orderstatus").alias("status"), "lines",
        F.date_format("o_orderdate", "yyyy-MM-dd").substr(F.lit(1), F.when(k % 4 == 0, F.lit(7)).otherwise(F.lit(10))).alias("placed"),
        F.struct(F.col("o_custkey").alias("key"), F.when(F.col("o_custkey") % 3 != 0, text("n", F.col("o_custkey"))).alias("note")).alias("customer"),
    ))
    total = F.when(k % 3 == 0, k.cast("string")).otherwise(text(k, ".25"))
    record = F.when(k % 11 == 0, F.lit("{cut off")).otherwise(text('{"total":', total, ",", F.substr(whole, F.lit(2))))
    return o.select("o_orderkey", F.col("o_orderpriority").alias("task_id"), record.alias("record"))


def _order_tasks(spark):
    return spark.createDataFrame([(t, dumps(s)) for t, s in ORDER_SCHEMAS.items()], "task_id string, schema string")


def record_conformance_by_task(spark, sf_dir):
    """Records of five tasks, each against its task's schema, nested items included."""
    v = conformance.conformance(_order_records(spark, sf_dir), _order_tasks(spark))
    return v.select(
        "o_orderkey", "task_id", "checked", F.size("violations").alias("n_violations"),
        F.array_join(F.array_sort(F.transform("violations", lambda x: F.concat_ws(" ", x["path"], x["keyword"], x["argument"]))), "; ").alias("violations"),
    )


def task_conformance_report(spark, sf_dir):
    """How many records of each task break each rule of its schema."""
    return conformance.report(conformance.conformance(_order_records(spark, sf_dir), _order_tasks(spark)))


def record_typed(spark, sf_dir):
    """Product records as a typed table; values that do not fit their type become NULL."""
    json = text(
        '{"name":"', F.col("p_name"), '","size":', F.col("p_size"), ',"price":', F.col("p_retailprice").cast("decimal(18,2)"),
        ',"listed":"', F.when(F.col("p_partkey") % 3 == 0, F.lit("soon")).otherwise(F.lit("2024-02-03")), '","tags":["', F.col("p_type"), '"]}',
    )
    t = table(spark, sf_dir, "part").select("p_partkey", records.typed(json, PRODUCT_SCHEMA).alias("t"))
    return t.select("p_partkey", "t.name", "t.size", "t.price", "t.listed", F.get("t.tags", F.lit(0)).alias("tag"))


def record_key_preview(spark, sf_dir):
    """First ten keys of wide records and how often each preview occurs."""
    li = heavy(spark, sf_dir, "lineitem")
    record = F.to_json(F.struct(*(F.col(c) if c != "l_tax" else F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax") for c in li.columns)))
    return (
        li.select(F.array_join(records.key_preview(record), ",").alias("keys"))
        .groupBy("keys").agg(F.count(F.lit(1)).alias("n"))
    )


def result_wrap(spark, sf_dir):
    """Lists of none, one or many results as one record, with size and emptiness."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.lit("[]")).when(k == 1, text("[", F.col("props"), "]")).when(k == 2, text("[", F.col("props"), ", {}]")).otherwise(F.col("props"))
    w = e.select("event_id", records.wrap_results(raw).alias("wrapped"))
    return w.select("event_id", "wrapped", records.size_chars(F.col("wrapped")).alias("chars"), records.truthy(F.col("wrapped")).alias("usable"))


def stage2_status(spark, sf_dir):
    """Extraction outcome of every event: the primary answer is its JSON, with all failure cases mixed in.

    Primary and fallback answers come as separate attempt rows and are joined to the page rows.
    """
    e = heavy(spark, sf_dir, "events").withColumn("m", F.col("event_id") % 11)
    m, u = F.col("m"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int") % 4
    keys = [text("run-", u).alias("run_id"), text("https://e.example.org/", F.col("event_id")).alias("url")]
    first = e.where(m != 3).select(
        *keys, F.lit(1).alias("attempt"),
        F.when(m == 4, F.lit("{bad")).when(m == 5, F.lit('[{"k":1}]')).when(m == 6, F.lit('{"other":1}')).otherwise(F.col("props")).alias("raw_content"),
    )
    second = e.select(
        *keys, F.lit(2).alias("attempt"),
        F.when(k == 0, F.lit("[]")).when(k == 1, F.lit('[{"k":5,"x":1}]')).when(k == 2, F.lit('[{"k":1},{"k":2}]')).otherwise(F.lit("[{}]")).alias("raw_content"),
    )
    joined = extract.with_attempts(e.select("*", *keys), first.unionByName(second))
    s = records.stage2(
        has_config=m != 0, prompt=F.when(m == 1, F.lit("")).otherwise(F.lit("p")), has_key=m != 2,
        crawl_ok=F.col("event_type") != "error", crawl_error=F.lit("HTTP 500"), primary=F.col("primary"), fallback=F.col("fallback"),
        fallback_enabled=u % 5 != 0, has_html=u % 7 != 0,
        schema=F.when(u % 3 != 0, F.lit('{"properties":{"k":{"type":"integer"}},"required":["k"]}')),
    )
    return joined.select("event_id", s.alias("s")).select("event_id", "s.*")


def date_price_normalize(spark, sf_dir):
    """Order dates and line prices written in mixed notations, read back in the agreed form."""
    d = F.col("o_orderdate")
    i = F.col("o_orderkey") % 6
    shown = (
        F.when(i == 0, F.date_format(d, "yyyy-M-d")).when(i == 1, F.date_format(d, "yyyy/MM/dd"))
        .when(i == 2, text(F.date_format(d, "yyyy"), "年", F.date_format(d, "M"), "月", F.date_format(d, "d"), "日"))
        .when(i == 3, F.date_format(d, "MMM d, yyyy")).when(i == 4, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("2024-13-01"))
    )
    c = F.col("o_totalprice").cast("decimal(18,2)")
    j = F.col("o_orderkey") % 4
    price = F.when(j == 0, text("¥", c)).when(j == 1, text("$", F.format_number("o_totalprice", 2))).when(j == 2, text(c, " 元")).otherwise(F.lit("free"))
    return heavy(spark, sf_dir, "orders").select(
        "o_orderkey", values.to_iso_date(shown).alias("iso_date"), values.price_text(price).alias("price"),
        values.price_currency(price).alias("currency"),
        values.tidy(text("<b>", F.col("o_orderpriority"), "</b>，  ok！")).alias("note"),
    )


def records_typed_table(spark, sf_dir):
    """Customers, orders and nations as JSON records of three kinds in one typed table; the status differs in type, so it stays JSON."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    record = lambda df, kind, **cols: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *(v.alias(k) for k, v in cols.items()))).alias("record"))
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7)
    all_kinds = (
        record(c, "customer", id=F.col("c_custkey"), amount=F.col("c_acctbal"), status=F.col("c_mktsegment"))
        .unionByName(record(o, "order", id=F.col("o_orderkey"), amount=F.col("o_custkey"), status=status, lines=F.array(F.col("o_orderstatus"), F.col("o_orderpriority"))))
        .unionByName(record(n, "nation", id=F.col("n_nationkey"), label=F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))))
    )
    return typed.typed_table(all_kinds).select(
        "kind", "id", F.col("amount").cast("double").alias("amount"), F.element_at("lines", 2).alias("priority"), F.col("label.name").alias("name"),
        F.col("label.region").alias("region"), "rest",
    )


QUERIES = {
    f.__name__: f
    for f in (
        records_typed_table,
        page_record_normalized, page_record_conformance, record_conformance_by_task, task_conformance_report, record_typed, record_key_preview, result_wrap, stage2_status, date_price_normalize,
    )
}

_TITLE = q.inline(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")

# Every rule as a condition over an order and its lines.
_ORDER_RULES = """l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_quantity > 40) AS big, bool_or(l_tax <> 0) AS lacks, bool_or(l_tax = 0) AS has,
  bool_or(l_returnflag NOT IN ('A', 'N')) AS odd, bool_or(l_linenumber % 2 = 1) AS slashed FROM lineitem GROUP BY 1),
o AS (SELECT *, o_orderkey % 11 <> 0 AS checked, coalesce(n, 0) AS lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
broken AS (
  SELECT o_orderkey, o_orderpriority AS task_id, x.path, x.keyword, x.argument FROM (SELECT *, unnest(list_filter([
    {'task': '1-URGENT', 'bad': lines = 0, 'path': '', 'keyword': 'required', 'argument': 'lines'},
    {'task': '1-URGENT', 'bad': lines IN (1, 2), 'path': '/lines', 'keyword': 'minItems', 'argument': '3'},
    {'task': '1-URGENT', 'bad': big, 'path': '/lines/*/qty', 'keyword': 'maximum', 'argument': '40'},
    {'task': '2-HIGH', 'bad': o_orderstatus NOT IN ('F', 'O'), 'path': '/status', 'keyword': 'enum', 'argument': '["F","O"]'},
    {'task': '2-HIGH', 'bad': o_custkey % 3 = 0, 'path': '/customer', 'keyword': 'required', 'argument': 'note'},
    {'task': '2-HIGH', 'bad': lacks, 'path': '/lines/*', 'keyword': 'required', 'argument': 'rest'},
    {'task': '3-MEDIUM', 'bad': lines > 5, 'path': '/lines', 'keyword': 'maxItems', 'argument': '5'},
    {'task': '3-MEDIUM', 'bad': odd, 'path': '/lines/*/flag', 'keyword': 'enum', 'argument': '["A","N"]'},
    {'task': '3-MEDIUM', 'bad': slashed, 'path': '/lines/*/dates/ship', 'keyword': 'format', 'argument': 'date'},
    {'task': '4-NOT SPECIFIED', 'bad': o_orderkey % 4 = 0, 'path': '/placed', 'keyword': 'format', 'argument': 'date'},
    {'task': '4-NOT SPECIFIED', 'bad': o_orderkey % 3 <> 0, 'path': '/total', 'keyword': 'type', 'argument': 'integer'},
    {'task': '4-NOT SPECIFIED', 'bad': o_orderkey < 100, 'path': '/id', 'keyword': 'minimum', 'argument': '100'},
    {'task': '5-LOW', 'bad': o_custkey % 3 <> 0 AND length('n' || o_custkey) < 4, 'path': '/customer/note', 'keyword': 'minLength', 'argument': '4'},
    {'task': '5-LOW', 'bad': true, 'path': '/customer/key', 'keyword': 'type', 'argument': 'string'},
    {'task': '5-LOW', 'bad': has, 'path': '/lines/*', 'keyword': 'additionalProperties', 'argument': 'false'}],
    lambda r: r.bad AND r.task = o_orderpriority)) AS x FROM o WHERE checked))"""

ORACLES = {
    "records_typed_table": """SELECT 'customer' AS kind, c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS priority,
  CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS region, '{"status":"' || c_mktsegment || '"}' AS rest FROM customer
UNION ALL SELECT 'order', o_orderkey, CAST(o_custkey AS DOUBLE), o_orderpriority, NULL, NULL,
  CASE WHEN o_orderkey % 3 <> 0 THEN '{"status":' || (o_orderkey % 7) || '}' END FROM orders
UNION ALL SELECT 'nation', n_nationkey, NULL, NULL, n_name, n_regionkey, NULL FROM nation""",
    "record_conformance_by_task": f"""WITH {_ORDER_RULES},
v AS (SELECT o_orderkey, count(*) AS n, string_agg(t, '; ' ORDER BY t) AS v FROM (
  SELECT o_orderkey, path || ' ' || keyword || ' ' || argument AS t FROM broken) GROUP BY 1)
SELECT o.o_orderkey, o_orderpriority AS task_id, checked, CAST(coalesce(v.n, 0) AS INTEGER) AS n_violations, coalesce(v, '') AS violations
FROM o LEFT JOIN v USING (o_orderkey)""",
    "task_conformance_report": f"WITH {_ORDER_RULES} SELECT task_id, path, keyword, argument, count(*) AS n FROM broken GROUP BY ALL",
    "page_record_normalized": f"""WITH p AS (SELECT page_id, url, nullif({_TITLE}, '') AS title, page_id % 6 AS m FROM pages),
j AS (SELECT *, to_json({{'title': title, 'url': url}}) AS kept FROM p)
SELECT page_id, CASE WHEN m IN (1, 2, 3) THEN NULL
         WHEN m = 5 THEN '{{"title":null,"url":' || CAST(to_json(url) AS VARCHAR) || '}}'
         WHEN m = 4 THEN '{{"error":false,' || substr(CAST(kept AS VARCHAR), 2) ELSE CAST(kept AS VARCHAR) END AS data,
       CASE m WHEN 1 THEN 'Missing required fields: title' WHEN 2 THEN 'Extracted data is not an object; cannot satisfy schema'
         WHEN 3 THEN 'JSON parse failed: not a JSON document' END AS error FROM j""",
    "page_record_conformance": f"""WITH t AS (SELECT page_id, len(string_split({q.inline(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ' ')) AS n FROM pages),
v AS (SELECT page_id, list_filter([
  CASE WHEN page_id % 7 = 0 THEN 'headline type:string' END,
  CASE WHEN page_id % 5 IN (0, 1) THEN 'printed.on format:date' END,
  CASE WHEN n < 3 THEN 'topics minItems' END,
  CASE WHEN n > 4 THEN 'topics maxItems' END,
  CASE WHEN page_id % 6 IN (0, 3) THEN 'grade enum' END,
  CASE WHEN page_id % 2 = 1 THEN 'size type:integer' END,
  CASE WHEN page_id % 8 = 2 THEN 'parts[] type:object' END,
  CASE WHEN page_id % 8 IN (0, 2) THEN 'parts[] required:n' END,
  CASE WHEN page_id % 8 = 1 THEN 'parts[].n type:integer' END], lambda x: x IS NOT NULL) AS v FROM t)
SELECT page_id, CAST(len(v) AS INTEGER) AS n_violations, array_to_string(v, '; ') AS violations FROM v""",
    "record_typed": """SELECT p_partkey, p_name AS name, CAST(p_size AS BIGINT) AS size, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
       CASE WHEN p_partkey % 3 <> 0 THEN DATE '2024-02-03' END AS listed, p_type AS tag FROM part""",
    "record_key_preview": """SELECT CASE WHEN l_tax > 0
         THEN 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus'
         ELSE 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_returnflag,l_linestatus,l_shipdate' END AS keys,
       count(*) AS n FROM lineitem GROUP BY 1""",
    "result_wrap": """WITH w AS (SELECT event_id, replace(props, ' ', '') AS p, event_id % 4 AS k FROM events),
x AS (SELECT event_id, CASE k WHEN 1 THEN p WHEN 2 THEN '{"items":[' || p || ',{}]}' END AS wrapped FROM w)
SELECT event_id, wrapped, CAST(length(wrapped) AS BIGINT) AS chars, wrapped IS NOT NULL AS usable FROM x""",
    "stage2_status": """WITH e AS (
  SELECT event_id, event_id % 11 AS m, user_id AS u, event_type <> 'error' AS ok, replace(props, ' ', '') AS p,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS k, user_id % 3 <> 0 AS has_schema FROM events),
a AS (SELECT *, m NOT IN (0, 1, 2) AS enabled,
        CASE WHEN m = 3 THEN 'LLM returned empty/no extracted_content' WHEN m = 4 THEN 'JSON parse failed: not a JSON document'
             WHEN m = 5 AND has_schema THEN 'Extracted data is not an object; cannot satisfy schema'
             WHEN m = 6 AND has_schema THEN 'Missing required fields: k' END AS e1,
        CASE m WHEN 5 THEN '[{"k":1}]' WHEN 6 THEN '{"other":1}' ELSE p END AS d1 FROM e),
f AS (SELECT *, CASE WHEN u % 5 = 0 THEN e1 WHEN u % 7 = 0 THEN 'LLM extraction failed and no HTML content for fallback'
             WHEN k IN (0, 3) THEN 'Both primary and fallback extraction failed'
             WHEN k = 2 AND has_schema THEN 'Missing required fields: k' END AS e2,
        CASE WHEN k = 1 AND has_schema THEN '{"k":5}' WHEN k = 1 THEN '{"k":5,"x":1}' WHEN k = 2 THEN '{"items":[{"k":1},{"k":2}]}' END AS d2 FROM a),
r AS (SELECT *, ok AND enabled AND e1 IS NULL AS first_ok, ok AND enabled AND e1 IS NOT NULL AND e2 IS NULL AS second_ok FROM f)
SELECT event_id, CASE WHEN first_ok THEN d1 WHEN second_ok THEN d2 END AS structured_data, enabled, first_ok OR second_ok AS success,
       CASE WHEN NOT ok THEN 'Crawl failed: HTTP 500' WHEN m = 0 THEN 'No LLM config provided' WHEN m = 1 THEN 'No prompt_template provided'
            WHEN m = 2 THEN 'Failed to create LLMConfig (likely missing API key)' WHEN first_ok OR second_ok THEN NULL ELSE e2 END AS error,
       CAST(length(CASE WHEN first_ok THEN d1 WHEN second_ok THEN d2 END) AS BIGINT) AS output_size_bytes, second_ok AS fallback_used FROM r""",
    "date_price_normalize": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso_date,
       CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN '$' || format('{:,.2f}', o_totalprice)
            ELSE '¥' || format('{:,.2f}', o_totalprice) END AS price,
       CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN 'USD' ELSE 'CNY' END AS currency,
       o_orderpriority || ' , ok!' AS note FROM orders""",
}
