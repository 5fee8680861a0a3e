"""Keyed merges of a new batch into a table snapshot.

Snapshots are rewritten to a new path (see ``sources.tables``), so every function here is a
plain DataFrame in, DataFrame out. A batch is first reduced to one row per key with partial
aggregation before the shuffle, so a hot key costs one row per task, and the join then sees
unique keys on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in the given total order, plus ``first_ts`` of the key's first row."""
    rest = [c for c in batch.columns if c not in keys]
    rank = F.struct(*order)
    return (
        batch.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("last"), F.min(order[0]).alias("first_ts"))
        .select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest), "first_ts")
    )


def upsert(
    current: DataFrame, batch: DataFrame, *, keys: Sequence[str], values: Sequence[str], order: Sequence[str],
    new_id: Column, as_of: Column | None = None,
) -> DataFrame:
    """Insert or update by key.

    A known key keeps ``id`` and ``created_at``, takes every value of the batch (NULL too) and
    bumps ``updated_at``. ``order`` starts with the batch's timestamp column.
    """
    ts = order[0]
    latest = collapse(batch.select(*{*keys, *values, *order}), keys, order)
    n = latest.select(
        *keys, F.lit(True).alias("hit"), *(F.col(v).alias(f"n_{v}") for v in values),
        F.col("first_ts").alias("n_first"), (F.col(ts) if as_of is None else as_of).alias("n_ts"), new_id.alias("n_id"),
    )
    take = lambda new, old: F.when(F.col("hit"), F.col(new)).otherwise(F.col(old))
    return current.join(n, list(keys), "full_outer").select(
        F.coalesce("id", "n_id").alias("id"),
        *keys,
        *(take(f"n_{v}", v).alias(v) for v in values),
        F.coalesce("created_at", "n_first").alias("created_at"),
        take("n_ts", "updated_at").alias("updated_at"),
    )


def registry_rows(crawls: DataFrame) -> DataFrame:
    """Successful crawls (url, task_id, ts) as registry rows, one per URL."""
    return crawls.groupBy("url").agg(
        F.max_by("task_id", F.struct("ts", "task_id")).alias("task_id"),
        F.min("ts").alias("first_crawled_at"),
        F.max("ts").alias("last_crawled_at"),
        F.count(F.lit(1)).alias("crawl_count"),
    )


def merge_registry(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Fold registry rows into the registry: counts add up, the latest crawl names the task."""
    cols = ["url", "task_id", "first_crawled_at", "last_crawled_at", "crawl_count"]
    return (
        registry.select(*cols)
        .unionByName(batch.select(*cols))
        .groupBy("url")
        .agg(
            F.max_by("task_id", F.struct("last_crawled_at", "task_id")).alias("task_id"),
            F.min("first_crawled_at").alias("first_crawled_at"),
            F.max("last_crawled_at").alias("last_crawled_at"),
            F.sum("crawl_count").alias("crawl_count"),
        )
    )


def apply_patches(rows: DataFrame, patches: DataFrame, *, key: str, fields: dict[str, str], patch_col: str = "patch") -> DataFrame:
    """Overwrite exactly the fields that each JSON patch names; an explicit null clears the field.

    ``fields`` maps patchable columns to their Spark type. Patches are unique per key.
    """
    named = lambda f: F.array_contains(F.json_object_keys(F.col(patch_col)), f)
    value = lambda f, t: F.from_json(F.col(patch_col), f"`{f}` {t}")[f]
    joined = rows.join(patches.select(key, patch_col), key, "left")
    return joined.select(
        *(
            F.when(F.coalesce(named(c), F.lit(False)), value(c, fields[c])).otherwise(F.col(c)).alias(c)
            if c in fields
            else F.col(c)
            for c in rows.columns
        )
    )
