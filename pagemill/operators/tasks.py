"""Task tables: provider and parameter resolution, references, listing, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Providers whose model names need a prefix, and their default endpoint.
PROVIDERS = [
    ("qwen", "openai/", "https://dashscope.aliyuncs.com/compatible-mode/v1"),
    ("ernie", "openai/", "https://aip.baidubce.com/rpc/2.0/ai_custom/v1/wenxinworkshop/chat"),
    ("deepseek", "deepseek/", None),
]

# Parameters handed to the extractor, and those that must never be stored or exported.
MODEL_PARAMS = ("temperature", "max_tokens", "top_p", "frequency_penalty", "presence_penalty", "stop", "n")
SECRETS = ("api_key", "api_token")

# Fields of an exported task.
EXPORT_FIELDS = (
    "name", "description", "urls", "crawl_config", "llm_provider", "llm_model", "llm_params", "prompt_template",
    "output_schema", "deduplication_enabled", "only_after_date", "fallback_download_enabled", "fallback_max_size_mb",
)

REFERENCE_DIRS = ("prompt_templates", "schemas")


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "known_provider string, model_prefix string, default_base_url string")


def resolve_providers(tasks: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``full_model`` and ``effective_base_url``."""
    model = F.col("llm_model")
    own = F.when(F.contains(model, F.lit("/")), model).otherwise(F.concat_ws("/", "llm_provider", model))
    return (
        tasks.join(known, F.lower("llm_provider") == F.col("known_provider"), "left")
        .withColumn("full_model", F.when(F.col("known_provider").isNotNull(), F.concat("model_prefix", model)).otherwise(own))
        .withColumn(
            "effective_base_url", F.coalesce(F.nullif(F.col("base_url"), F.lit("")), F.col("default_base_url"))
        )
        .drop(*known.columns)
    )


def merge_params(defaults: Column, own: Column) -> Column:
    """Defaults overlaid by the task's parameters; a null of the task wins too. Both are maps."""
    task = F.coalesce(own, F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(task, k)), task)


def has_key(params: Column) -> Column:
    return F.coalesce(F.try_element_at(params, F.lit("api_key")), F.lit("")) != ""


def merged_config(provider: Column, model: Column, params: Column) -> Column:
    """struct<provider, model, params>, NULL when provider, model or the key is missing."""
    set_ = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(
        set_(provider) & set_(model) & has_key(params),
        F.struct(provider.alias("provider"), model.alias("model"), params.alias("params")),
    )


def model_params(params: Column) -> Column:
    """The parameters an extractor may see; a base URL only when set, keys never."""
    return F.map_filter(
        params, lambda k, v: k.isin(*MODEL_PARAMS) | ((k == "base_url") & (F.coalesce(v, F.lit("")) != ""))
    )


def without_secrets(params: Column) -> Column:
    return F.map_filter(params, lambda k, _: ~k.isin(*SECRETS))


def effective_prompt(own: Column, default: Column) -> Column:
    """The task's prompt, else the default; both already resolved."""
    return F.coalesce(F.nullif(own, F.lit("")), default)


def resolve_references(tasks: DataFrame, library: DataFrame, column: str, *, schema: bool) -> DataFrame:
    """Replace ``@directory/file`` values by the file's content; ``{column}_error`` tells why not.

    ``library`` has (dir, file, content). Plain prompts pass, plain-text schemas are an error, JSON
    objects pass. Spark picks the join from the library's size. The error texts are fixed values.
    """
    v = F.col(column)
    is_ref = F.startswith(v, F.lit("@"))
    parts = F.split(F.substr(v, F.lit(2)), "/", 2)
    lib = library.select(F.col("dir").alias("lib_dir"), F.col("file").alias("lib_file"), F.col("content").alias("lib_content"))
    staged = tasks.withColumn("ref_dir", F.when(is_ref, F.get(parts, F.lit(0)))).withColumn(
        "ref_file", F.when(is_ref, F.get(parts, F.lit(1)))
    )
    joined = staged.join(lib, (F.col("ref_dir") == F.col("lib_dir")) & (F.col("ref_file") == F.col("lib_file")), "left")
    content = F.col("lib_content")
    error = (
        F.when(is_ref & F.col("ref_file").isNull(), F.concat(F.lit("Invalid file reference format: "), v))
        .when(is_ref & ~F.col("ref_dir").isin(*REFERENCE_DIRS), F.concat(F.lit("Invalid directory in reference: "), v))
        .when(is_ref & content.isNull(), F.concat(F.lit("Referenced file not found: "), v))
    )
    if schema:
        error = error.when(
            is_ref & F.try_parse_json(content).isNull(), F.concat(F.lit("Invalid JSON in schema file "), v)
        ).when(
            ~is_ref & (v != "") & ~F.startswith(F.ltrim(v), F.lit("{")),
            F.concat(F.lit("Invalid schema format: "), v),
        )
    return (
        joined.withColumn(f"{column}_error", error)
        .withColumn(column, F.when(F.col(f"{column}_error").isNotNull(), F.lit(None)).when(is_ref, content).otherwise(v))
        .drop("ref_dir", "ref_file", "lib_dir", "lib_file", "lib_content")
    )


def list_tasks(tasks: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of the task list in a stable order."""
    return tasks.orderBy("created_at", "task_id").offset(skip).limit(limit)


def list_tasks_after(tasks: DataFrame, after: tuple | None = None, limit: int = 100) -> DataFrame:
    """The next page of the same list: the rows behind ``after``, the (created_at, task_id) of the last row seen.

    A range filter on ``created_at`` reaches the scan and each task keeps its first ``limit`` rows, so a late page costs
    no more than an early one; rows that come or go on earlier pages move nothing. Tasks without a date come first.
    """
    if after is not None:
        at, last = F.lit(after[0]).cast(tasks.schema["created_at"].dataType), F.lit(after[1])
        at_or_behind = F.col("created_at").isNull() & (F.col("task_id") > last) | F.col("created_at").isNotNull()
        if after[0] is not None:
            at_or_behind = (F.col("created_at") >= at) & ((F.col("created_at") > at) | (F.col("task_id") > last))
        tasks = tasks.where(at_or_behind)
    return tasks.orderBy("created_at", "task_id").limit(limit)


def export_json(tasks: DataFrame) -> Column:
    """Exported form of a task as JSON text, keys left out."""
    fields = [without_secrets(F.col(f)).alias(f) if f == "llm_params" else F.col(f) for f in EXPORT_FIELDS if f in tasks.columns]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
