"""Reading pages, task files, template libraries and stored media."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import urls
from pagemill.sources import schemas


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def stream_path(path: str) -> str:
    """The path as a pattern that matches only itself: a stream accepts a single file only that way."""
    return f"{path[:-1]}[{path[-1]}]"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(stream_path(path))


def yaml_to_json(text: Column) -> Column:
    """One YAML document per value as JSON text; NULL when it does not parse.

    Marked as not deterministic, so that each text is parsed once: a filter on what is read from the JSON would else be
    pushed below, with a second parse of its own.
    """

    def batch(texts: pd.Series) -> pd.Series:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def one(t):
            try:
                return json.dumps(yaml.load(t, loader), ensure_ascii=False, default=str)
            except (yaml.YAMLError, AttributeError, TypeError):
                return None

        return texts.map(one)

    return F.pandas_udf(batch, T.StringType()).asNondeterministic()(text)


def json_to_yaml(text: Column) -> Column:
    """One JSON document per value as YAML text."""

    def batch(texts: pd.Series) -> pd.Series:
        import yaml

        dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
        return texts.map(
            lambda t: None
            if t is None
            else yaml.dump(json.loads(t), Dumper=dumper, default_flow_style=False, allow_unicode=True)
        )

    return F.pandas_udf(batch, T.StringType())(text)


def _with_defaults(config: Column, field: str, default) -> Column:
    return F.coalesce(config[field], F.lit(default)).alias(field)


def parse_tasks(text_rows: DataFrame, column: str, source: str | None = None) -> DataFrame:
    """JSON task definitions as typed rows with defaults; ``parse_error`` is set where that failed.

    Schemas may be objects or references, so they stay JSON text; dates are ISO text.
    """
    c = F.from_json(F.col(column), schemas.TASK_CONFIG)
    keep = [source] if source else []
    rows = text_rows.select(*keep, F.col(column).alias("raw"), c.alias("c"))
    crawl = F.col("c.crawl_config")
    # Defaults of a task.
    config = F.struct(
        crawl["js_code"].alias("js_code"), crawl["wait_for"].alias("wait_for"), crawl["css_selector"].alias("css_selector"),
        crawl["content_selector"].alias("content_selector"), _with_defaults(crawl, "screenshot", False), _with_defaults(crawl, "pdf", False),
        _with_defaults(crawl, "verbose", True), crawl["content_filter_threshold"].alias("content_filter_threshold"),
        _with_defaults(crawl, "stage2_fallback_enabled", True),
    )
    when = F.coalesce(
        F.try_to_timestamp(F.col("c.only_after_date")).cast("timestamp_ntz"), F.col("c.only_after_date").try_cast("timestamp_ntz")
    )
    return rows.select(
        *keep, "c.name", "c.description", "c.urls", config.alias("crawl_config"), "c.llm_provider", "c.llm_model", "c.llm_params",
        "c.prompt_template", "c.output_schema",
        F.coalesce("c.deduplication_enabled", F.lit(True)).alias("deduplication_enabled"), when.alias("only_after_date"),
        F.coalesce("c.fallback_download_enabled", F.lit(True)).alias("fallback_download_enabled"),
        F.coalesce("c.fallback_max_size_mb", F.lit(10)).alias("fallback_max_size_mb"),
        F.when(F.try_parse_json("raw").isNull(), F.lit("not a JSON or YAML document"))
        .when(F.col("c.only_after_date").isNotNull() & when.isNull(), F.lit("only_after_date is no ISO date")).alias("parse_error"),
    )


def task_files(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """All task definitions in a folder of JSON or YAML files, one task per file."""
    if fmt not in ("json", "yaml"):
        raise ValueError("Format must be 'json' or 'yaml'")
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    if fmt == "yaml":
        text = text.withColumn("value", yaml_to_json(F.col("value")))
    return parse_tasks(text, "value", "file")


def library(spark: SparkSession, path: str) -> DataFrame:
    """Template or schema files below ``path/{dir}/`` as (dir, file, content)."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select(
        F.url_decode(F.element_at(parts, -2)).alias("dir"), F.url_decode(F.element_at(parts, -1)).alias("file"), F.col("value").alias("content")
    )


# Media types by file extension.
MIME_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "pdf": "application/pdf", "zip": "application/zip", "csv": "text/csv", "txt": "text/plain",
}


def mime_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, urls.extension(path)), F.lit("application/octet-stream"))


def blobs(spark: SparkSession, path: str, max_size_mb: int = 10, content: bool = False) -> DataFrame:
    """Stored media files up to a size (equal passes): path, filename, length, mime_type.

    The size filter is pushed to the file listing; contents are read only on request.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .where(F.col("length") <= max_size_mb * 1024 * 1024)
    )
    cols = ["path", urls.filename(F.col("path")).alias("filename"), "length", mime_type(F.col("path")).alias("mime_type")]
    return files.select(*cols, *(["content"] if content else []))
