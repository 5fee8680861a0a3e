"""Download state of images and attachments against a store of fetched blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls


def within_limit(length: Column, max_size_mb: Column) -> Column:
    """A size equal to the limit passes."""
    return length <= max_size_mb.cast("bigint") * 1024 * 1024


def resolve_media(media: DataFrame, blobs: DataFrame) -> DataFrame:
    """Status of each media row (original_url, downloaded, fallback_enabled, max_size_mb, run_date, run_id).

    ``blobs`` is the index of fetched files (original_url, length, mime_type); of several files of one URL the largest
    counts. File contents do not take part. Rows without a URL yield no row.
    """
    blobs = blobs.groupBy("original_url").agg(F.max(F.struct("length", "mime_type")).alias("b")).select("original_url", "b.*")
    rows = media.where(F.coalesce("original_url", F.lit("")) != "").join(blobs, "original_url", "left")
    fetched = F.coalesce(within_limit(F.col("length"), F.col("max_size_mb")), F.lit(False))
    # States and methods of a download.
    state = (
        F.when(F.col("downloaded"), F.struct(F.lit("success").alias("s"), F.lit("crawl4ai").alias("m")))
        .when(~F.col("fallback_enabled"), F.struct(F.lit("skipped").alias("s"), F.lit(None).cast("string").alias("m")))
        .when(fetched, F.struct(F.lit("success").alias("s"), F.lit("fallback").alias("m")))
        .otherwise(F.struct(F.lit("failed").alias("s"), F.lit(None).cast("string").alias("m")))
    )
    by_fallback = F.col("state.m") == "fallback"
    path = urls.artifact_path(F.col("run_date"), F.col("run_id"), "images", urls.filename(F.col("original_url")))
    keep = [c for c in media.columns if c not in ("downloaded", "fallback_enabled", "max_size_mb", "run_date")]
    return rows.withColumn("state", state).select(
        *keep,
        F.when(F.col("state.s") == "success", path).alias("minio_path"),
        F.when(by_fallback, F.col("length")).alias("size_bytes"),
        F.when(by_fallback, F.coalesce("mime_type", F.lit("application/octet-stream"))).alias("mime_type"),
        F.col("state.s").alias("download_status"),
        F.col("state.m").alias("download_method"),
    )
