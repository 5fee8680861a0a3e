"""Streaming forms of ingest, registry, deduplication and run monitoring.

Every job keeps its checkpoint in the shared folder. Sinks written per micro-batch use the
batch number as folder name, so a batch that runs twice after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import frontier, pages as page_ops, upsert
from pagemill.sources import tables

REGISTRY_COLUMNS = ["url", "task_id", "first_crawled_at", "last_crawled_at", "crawl_count"]


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into a parquet folder, then stop."""
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def per_batch(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    q = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def ingest(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Raw pages to cleaned pages; stateless, so it scales with the input alone.

    ``partitions`` spreads micro-batches of few large files over the cores.
    """
    if partitions:
        pages = pages.repartition(partitions)
    return page_ops.text_versions(pages).select("page_id", "url", "raw", "fit", "fallback_used")


def registry_deltas(crawls: DataFrame, out: str, checkpoint: str) -> None:
    """Write the registry rows of each micro-batch as a delta.

    The merge is associative, so no state is kept and the registry is not rewritten per batch:
    readers fold the deltas, ``compact_registry`` replaces them by one snapshot now and then.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert.registry_rows(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    per_batch(crawls, write, checkpoint)


def read_registry(spark: SparkSession, out: str, snapshots: str | None = None) -> DataFrame:
    """The registry now: the current snapshot, if there are any, plus the deltas after it.

    A snapshot's version is the number of the last batch it contains, so the newer deltas are
    picked by partition pruning.
    """
    deltas = spark.read.parquet(out)
    if snapshots is None:
        return upsert.merge_registry(deltas.limit(0).select(*REGISTRY_COLUMNS), deltas)
    version, path = tables.current_version(spark, snapshots)
    return upsert.merge_registry(spark.read.parquet(path), deltas.where(F.col("batch") > version))


def compact_registry(spark: SparkSession, out: str, snapshots: str, first: bool = False, keep: int = 1) -> None:
    """Fold all deltas so far into a new snapshot; ``first`` starts the list of snapshots.

    Deltas that the last ``keep`` snapshots hold already are removed; the newest ``keep`` batches stay as a grace for
    readers that still go by the snapshot before, and so does the last folder, which carries the columns.
    """
    last = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    before = None if first else tables.current_version(spark, snapshots)[0]
    folded = read_registry(spark, out, None if first else snapshots)
    tables.write_version(folded, snapshots, last)
    if before is not None:
        tables.remove_batches(spark, out, min(before, last - keep))


def dedup_bounded(urls: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First row per URL within the watermark; state older than ``delay`` is dropped."""
    return urls.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def dedup_exact(frontier_stream: DataFrame, registry, out: str, checkpoint: str) -> None:
    """The first row of every URL that neither the registry nor an earlier batch has, batch by batch.

    ``frontier_stream`` has ``url``, ``deduplication_enabled`` and ``seq`` (its order); rows without deduplication all
    pass. ``registry()`` gives the known URLs; URLs that earlier batches accepted are read from their own output, so a
    batch that runs twice sees the same and replaces what it wrote.
    """
    spark = frontier_stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        on = F.coalesce(F.col("deduplication_enabled"), F.lit(True))
        first = batch.where(on).groupBy("url").agg(F.min_by(F.struct(*batch.columns), "seq").alias("r")).select("r.*")
        known = registry().select("url")
        if batch_id:
            known = known.unionByName(spark.read.parquet(out).where((F.col("batch") < batch_id) & on).select("url"))
        fresh = frontier.minus_registry(first, known.distinct())
        fresh.unionByName(batch.where(~on)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    per_batch(frontier_stream, write, checkpoint)


def state_session(spark: SparkSession, partitions: int) -> SparkSession:
    """A session of its own for keyed state: RocksDB on the executors' disks, changes only written to the checkpoint.

    A checkpoint keeps its number of state partitions for good, so it is a parameter: choose it for the keys to come.
    The caller's session stays as it is.
    """
    own = spark.newSession()
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    own.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def _until_done(stream: DataFrame, out: str, checkpoint: str) -> list[dict]:
    """Process what is there into a parquet folder; one entry per batch: rows in, keys held, and rows too late to count."""
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return [
        {
            "batch": p.batchId, "rows": p.numInputRows, "keys": sum(s.numRowsTotal for s in p.stateOperators),
            "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
        }
        for p in q.recentProgress
    ]


def known_urls(known: DataFrame, inbox: str) -> None:
    """Put the URLs of a registry into the inbox of ``dedup_keyed``, in its columns; run it on them before other rows come."""
    rows = known.where(F.col("url").isNotNull()).select("url").distinct()
    rows.select("url", F.lit(True).alias("deduplication_enabled"), F.lit(None).cast("bigint").alias("seq"), F.lit(True).alias("known")).write.mode(
        "append"
    ).parquet(inbox)


def new_urls(rows: DataFrame, inbox: str) -> None:
    """Put frontier rows (``url, deduplication_enabled, seq``) into the inbox of ``dedup_keyed``."""
    rows.select("url", "deduplication_enabled", F.col("seq").cast("bigint").alias("seq"), F.lit(False).alias("known")).write.mode("append").parquet(inbox)


_INBOX = "url STRING, deduplication_enabled BOOLEAN, seq BIGINT, known BOOLEAN"


def dedup_keyed(spark: SparkSession, inbox: str, out: str, checkpoint: str, partitions: int = 200, files: int | None = None) -> list[dict]:
    """A row of every URL that is new, whatever the time between its rows; rows without deduplication all pass.

    The URLs seen so far, the registry's among them, are keyed state that is never dropped, so a batch reads its own
    rows and looks up its own keys: it neither joins the registry nor reads what earlier batches put out. Of several
    rows of one URL in the same batch any one passes. A null URL counts as one URL, a null flag as enabled. Start with
    ``known_urls`` and one run on them; rows that are there with them may win against the registry.
    """
    own = state_session(spark, partitions)
    source = own.readStream.schema(_INBOX)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    rows = source.parquet(inbox)
    on = F.coalesce(F.col("deduplication_enabled"), F.lit(True))
    fresh = rows.where(on).dropDuplicates(["url"]).unionByName(rows.where(~on))
    return _until_done(fresh.where(~F.col("known")).drop("known"), out, checkpoint)


def ended_runs(starts: DataFrame, ends: DataFrame, limit: str, delay: str) -> DataFrame:
    """Every started run with its end, or as an error once its time limit has passed without one.

    ``starts``: ``run_id, task_id, started_at``; ``ends``: ``run_id, completed_at, status`` (streams, timestamps). A run
    whose end came later than ``limit`` after its start, or never, gets ``status`` ``error`` and no ``completed_at``; that
    row comes when the watermark, the later rows' time less ``delay``, has passed the limit, and the state goes with it. Rows
    behind the watermark are left out and counted as late. An end in time but without a start gives no row.
    """
    s = starts.withWatermark("started_at", delay)
    e = ends.select(F.col("run_id").alias("ended"), "completed_at", "status").withWatermark("completed_at", delay)
    within = F.expr(f"ended = run_id AND completed_at >= started_at AND completed_at <= started_at + INTERVAL {limit}")
    lost = F.col("ended").isNull()
    return s.join(e, within, "left_outer").select(
        "run_id", "task_id", "started_at", "completed_at", F.when(lost, F.lit("error")).otherwise(F.col("status")).alias("status"),
        F.when(lost, F.lit(f"no end within {limit}")).alias("error"),
    )


_STARTS = "run_id STRING, task_id STRING, started_at TIMESTAMP"
_ENDS = "run_id STRING, completed_at TIMESTAMP, status STRING"


def watch_runs(spark: SparkSession, starts: str, ends: str, out: str, checkpoint: str, limit: str, delay: str, partitions: int = 200) -> list[dict]:
    """Run ``ended_runs`` over what has come into two folders; may be called again and again on the same checkpoint."""
    own = state_session(spark, partitions)
    s, e = own.readStream.schema(_STARTS).parquet(starts), own.readStream.schema(_ENDS).parquet(ends)
    return _until_done(ended_runs(s, e, limit, delay), out, checkpoint)


def monitor(attempts: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Outcomes per tumbling window; rows later than the watermark are dropped."""
    status = F.when(F.col("crawl_ok"), F.lit("success")).otherwise(F.lit("failure"))
    return (
        attempts.select(F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "status", "n")
    )


def monitor_updates(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Write the windows that each batch changed; ``read_monitor`` keeps the last state of each."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("seq", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    per_batch(counts, write, checkpoint, "update")


def read_monitor(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("window_start", "status").agg(F.max_by("n", "seq").alias("n"))
