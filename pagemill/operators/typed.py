"""One typed table from records of many schemas, found from the records themselves.

Every top-level field gets the narrowest type that holds all its values: whole numbers and decimals widen to a decimal
(or a double), objects and arrays merge field by field. Where values have no common type, the field has no column; its
values stay as they are in ``rest``, a JSON object. So does whatever isn't an object, as it was written. Nothing is dropped.

Edge cases: a null record has nulls only; a JSON null and an absent field both give a null; a field that is null in all
records is a string; invalid JSON, also an object that names a field twice, goes to ``rest`` as text; of names
that differ in case only, the first in order gets the column and the others stay in ``rest``; a field with the
name of a carried column gets an underscore behind it; an empty table has no typed columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Typed columns at most: the fields that most records have. Others stay in ``rest``.
MOST_FIELDS = 1000

_PLAIN = re.compile(r"[A-Za-z0-9_:<>,() ]+")


def _parsed(records: DataFrame, record: str) -> DataFrame:
    """``records`` with ``__v`` (the whole), and ``__m``: the fields of an object, else null."""
    v = records.withColumn("__v", F.try_parse_json(record))
    is_object = F.schema_of_variant("__v").startswith("OBJECT<")
    return v.withColumn("__m", F.when(is_object, F.col("__v").cast("map<string, variant>")))


def fields(records: DataFrame, record: str = "record") -> DataFrame:
    """``field, shape, n``: each top-level field, the type that holds all its values (``VARIANT``: none does), and its records.

    Types combine before the shuffle, so a field that all records have costs a row per task.
    """
    each = _parsed(records.select(record), record).select(F.explode("__m").alias("field", "value"))
    return each.groupBy("field").agg(F.schema_of_variant_agg("value").alias("shape"), F.count(F.lit(1)).alias("n"))


def column_types(found: list[tuple[str, str]]) -> dict[str, str]:
    """Fields that get a column, in order of their names, with Spark's name of the type."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for name, shape in sorted(found):
        # A type that mixes in a VARIANT somewhere, or that has names Spark would have to quote, stays as JSON.
        if "VARIANT" in shape or not _PLAIN.fullmatch(shape) or name.lower() in taken:
            continue
        taken.add(name.lower())
        out[name] = "STRING" if shape == "VOID" else shape.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    return out


def typed_table(records: DataFrame, record: str = "record", most: int = MOST_FIELDS) -> DataFrame:
    """``records`` without ``record``, a column for each typed field, and ``rest``.

    Takes two passes: one for the fields (``most`` rows of them reach the driver), one that fills the table row by row.
    """
    found = fields(records, record).orderBy(F.desc("n"), "field").limit(most).collect()
    types = column_types([(r["field"], r["shape"]) for r in found])
    carried = [c for c in records.columns if c != record]
    taken = {c.lower() for c in carried}

    def free(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        return name

    rest = free("rest")
    named = {f: free(f) for f in types}
    typed = [F.try_variant_get(F.element_at("__m", F.lit(f)), "$", t).alias(named[f]) for f, t in types.items()]
    known = F.array(*map(F.lit, types)) if types else F.array().cast("array<string>")
    left = F.map_filter("__m", lambda k, _: ~F.array_contains(known, k))
    whole = F.when(F.col("__m").isNull(), F.col(record)).when(F.size(left) > 0, F.to_json(left))
    return _parsed(records, record).select(*(F.col(f"`{c}`") for c in carried), *typed, whole.alias(rest))
