"""Metrics of attempts that can be merged: stored per day and task, added up over any period without reading attempts again.

Distinct URLs are a HyperLogLog sketch per day and task: with ``precision`` p its relative standard error is about
1.04 / sqrt(2^p), and small sets are exact. Durations are counted in log-linear classes: 0 to 127 one by one, above
that 64 classes for each doubling, so a quantile is off by at most 1 / 64 of itself, at most 4,000 classes cover all
64-bit numbers, and merging adds counts, which is exact. Both sketches stay small however many attempts there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRECISION = 16
KEYS = ("run_date", "task_id")


def duration_class(duration: Column) -> Column:
    """The class of a whole number; negative ones count as 0, null has none."""
    d = F.greatest(duration.cast("long"), F.lit(0).cast("long"))
    shift = F.greatest(F.length(F.bin(d)) - 7, F.lit(0))
    return F.when(duration.isNotNull(), shift.cast("long") * 128 + F.call_function("shiftright", d, shift))


def class_middle(bucket: Column) -> Column:
    """The number in the middle of a class."""
    shift = F.floor(bucket / 128).cast("int")
    low = F.call_function("shiftleft", F.pmod(bucket, F.lit(128)), shift)
    return low + F.call_function("shiftright", F.call_function("shiftleft", F.lit(1).cast("long"), shift), F.lit(1))


def daily_counts(attempts: DataFrame, precision: int = PRECISION) -> DataFrame:
    """``run_date, task_id, attempts, succeeded, urls``: one row per day and task, ``urls`` a sketch."""
    return attempts.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("succeeded"), F.hll_sketch_agg("url", precision).alias("urls")
    )


def daily_durations(attempts: DataFrame) -> DataFrame:
    """``run_date, task_id, bucket, n``: attempts with a duration by class."""
    return attempts.where("duration is not null").groupBy(*KEYS, duration_class(F.col("duration")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def write_metrics(attempts: DataFrame, base: str, batch: int, precision: int = PRECISION) -> None:
    """Store the metrics of a batch of attempts: ``run_date, task_id, url, ok, duration`` (a whole number of any unit).

    Later batches may hold attempts of the same days; a batch that is written again replaces itself.
    """
    daily_counts(attempts, precision).write.mode("overwrite").parquet(f"{base}/counts/batch={batch}")
    daily_durations(attempts).write.mode("overwrite").parquet(f"{base}/durations/batch={batch}")


def quantiles(durations: DataFrame, keys: tuple[str, ...], percents: tuple[int, ...]) -> DataFrame:
    """``p50`` and so on for each key: the middle of the class that holds the quantile's rank."""
    merged = durations.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    # A window holds one key's classes, of which there are at most 4,000.
    w = Window.partitionBy(*keys)
    upto = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.select(*keys, "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
    return ranked.groupBy(*keys).agg(*(class_middle(at(p)).alias(f"p{p}") for p in percents))


def over_period(
    spark: SparkSession, base: str, since: str | None = None, until: str | None = None, keys: tuple[str, ...] = ("task_id",), percents: tuple[int, ...] = (50, 90, 99)
) -> DataFrame:
    """The metrics of the days from ``since`` to ``until``, both included, by any of the stored keys.

    A null task or day is a key of its own. Reads the stored rows of the period alone.
    """

    def days(name: str) -> DataFrame:
        df = spark.read.parquet(f"{base}/{name}")
        df = df if since is None else df.where(F.col("run_date") >= F.lit(since).cast("date"))
        return df if until is None else df.where(F.col("run_date") <= F.lit(until).cast("date"))

    counts = days("counts").groupBy(*keys).agg(
        F.sum("attempts").alias("attempts"), F.sum("succeeded").alias("succeeded"), F.hll_sketch_estimate(F.hll_union_agg("urls", F.lit(True))).alias("distinct_urls")
    )
    q = quantiles(days("durations"), keys, percents)
    same = [counts[k].eqNullSafe(q[k]) for k in keys]
    return counts.join(q, same, "left").select(*(counts[k] for k in keys), "attempts", "succeeded", "distinct_urls", *(f"p{p}" for p in percents))
