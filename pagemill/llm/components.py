"""Connected components of a table of links, by alternating stars; every step is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs with the smallest ``v`` of their ``u``. The minima are stored, so that the join's hot nodes can be split."""
    return pairs.join(stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "least"), "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(both).withColumn("m", F.least("m", "u"))
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    near = _with_least(edges)
    return near.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(
        F.col("e.v").alias("u"), F.col("e.m").alias("v")
    ).where("u <> v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``u, v``) but the roots; the root is the smallest node reachable."""
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "links")
    before = _state(edges)
    while before[0]:
        edges = stored(_small(stored(_large(edges).distinct(), "large-star")).distinct(), "small-star")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
