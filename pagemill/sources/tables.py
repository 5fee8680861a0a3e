"""Table snapshots in versions, and partitioned sinks.

A snapshot is never overwritten in place: a new version goes to its own folder, then one row
in the version list makes it current. A lost executor or a failed job leaves the old version
valid, and a repeated write of a version replaces only that version's folder.
"""

from __future__ import annotations

import os
from urllib.parse import quote
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import ship

_VERSIONS = "version BIGINT, path STRING"


def write_version(df: DataFrame, base: str, version: int) -> str:
    path = f"{base}/data/v{version}"
    df.write.mode("overwrite").parquet(path)
    row = df.sparkSession.createDataFrame([(version, path)], _VERSIONS)
    row.coalesce(1).write.mode("overwrite").parquet(f"{base}/versions/v={version}")
    return path


def current_version(spark: SparkSession, base: str) -> tuple[int, str]:
    """Number and path of the highest version; the list has one small row per version."""
    listed = spark.read.schema(_VERSIONS).option("recursiveFileLookup", "true").parquet(f"{base}/versions")
    return tuple(listed.agg(F.max("version"), F.max_by("path", "version")).first())


def read_current(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(current_version(spark, base)[1])


def remove_batches(spark: SparkSession, out: str, up_to: int) -> None:
    """Delete the folders ``batch=N`` up to a number. Only names are listed; a folder that is gone already is no error."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) <= up_to:
            files.delete(status.getPath(), True)


def write_by_run(df: DataFrame, path: str, *outer: str) -> None:
    """Write rows below ``run_date=/run_id=`` folders, replacing only the runs in ``df``.

    ``outer`` columns become folders above these. The rebalance hint gathers each folder in few
    files and splits one that would overload a task.
    """
    folders = [*outer, "run_date", "run_id"]
    (
        df.hint("rebalance", *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders).parquet(path)
    )


def artifact_rows(documents: DataFrame) -> DataFrame:
    """One row per artifact: kind, run_date, run_id, id, content.

    Needs run_date, run_id, id, raw, fit, structured_data, success. A record is kept only where
    extraction succeeded and the record is not empty.
    """
    from pagemill.functions.records import truthy

    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    made = lambda cond, kind, c: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.col(c).alias("content")))
    kinds = F.array_compact(
        F.array(
            made(has("raw"), "markdown", "raw"), made(has("fit"), "markdown_cleaned", "fit"),
            made(F.col("success") & truthy(F.col("structured_data")), "json", "structured_data"),
        )
    )
    return documents.select("run_date", "run_id", "id", F.inline(kinds))


def write_artifacts(documents: DataFrame, base: str) -> None:
    """Raw text, cleaned text and records of documents below ``kind=``, in one pass over the documents."""
    write_by_run(artifact_rows(documents), base, "kind")


def write_run_logs(manifests: DataFrame, index: DataFrame, errors: DataFrame, base: str) -> None:
    """Manifests, resource index and error logs; runs without errors have no error log.

    All three carry run_date and run_id.
    """
    write_by_run(manifests, f"{base}/run_manifest")
    write_by_run(index, f"{base}/resource_index")
    write_by_run(errors, f"{base}/error_log")


#: Files of a folder: folders are listed by tasks, each as a whole.
FOLDER = 1000


def local_path(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder in the machines' own file system; ``None`` in any other store."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(root).toUri().getPath() if files.getUri().getScheme() == "file" else None


class _Checked:
    """A new file, with the CRC-32 of each 512 bytes beside it, as Hadoop's local file system makes and reads it.

    Both get their names when they are whole.
    """

    def __init__(self, folder: str, name: str, attempt: int):
        self.name, self.sums_name = f"{folder}/{name}", f"{folder}/.{name}.crc"
        self.temporary = [f"{folder}/.{name}.{attempt}", f"{folder}/.{name}.{attempt}.crc"]
        self.out, self.rest = open(self.temporary[0], "wb"), b""
        self.sums = [b"crc\0" + (512).to_bytes(4, "big")]

    def write(self, data: bytes) -> None:
        self.out.write(data)
        data = memoryview(self.rest + data)
        whole = len(data) // 512 * 512
        self.sums += [crc32(data[i : i + 512]).to_bytes(4, "big") for i in range(0, whole, 512)]
        self.rest = bytes(data[whole:])

    def done(self) -> None:
        self.out.close()
        if self.rest:
            self.sums.append(crc32(self.rest).to_bytes(4, "big"))
        with open(self.temporary[1], "wb") as f:
            f.write(b"".join(self.sums))
        os.replace(self.temporary[1], self.sums_name)
        os.replace(self.temporary[0], self.name)

    def drop(self) -> None:
        self.out.close()
        for path in self.temporary:
            if os.path.exists(path):
                os.remove(path)


def write_files(rows: DataFrame, base: str, key: str) -> None:
    """A text file for each value of ``key``, with ``{key}={value}`` in its path.

    ``rows``: ``key, value, times``; a row adds its value that many times and a line end. Rows of one key must be in one
    partition, whose task makes the files. In a local or mounted file system Hadoop starts processes for each file, to set
    its rights, unless its native library is there; so tasks open files themselves, some to a folder, with Hadoop's
    checksums. Other stores get a folder for each file from Spark.
    """
    root = local_path(rows.sparkSession, base)
    if root is None:
        named = rows.select(key, F.repeat("value", F.col("times")).alias("value"))
        named.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(base)
        return
    ship(rows.sparkSession)

    def fn(batches):
        context = TaskContext.get()
        task, n, last, out = context.partitionId(), 0, None, None
        try:
            for b in batches:
                for k, value, times in zip(*(b.column(c).to_pylist() for c in ("key", "value", "times")), strict=True):
                    k = "__HIVE_DEFAULT_PARTITION__" if k is None else quote(k, safe="")
                    if out is None or k != last:
                        if out is not None:
                            out.done()
                        folder = f"{root}/{task:05d}-{n // FOLDER:05d}"
                        if n % FOLDER == 0:
                            os.makedirs(folder, exist_ok=True)
                        out = _Checked(folder, f"{key}={k}-{task:05d}.txt", context.taskAttemptId())
                        last, n = k, n + 1
                    for _ in range(0 if value is None else times or 0):
                        out.write(value)
                    out.write(b"\n")
            if out is not None:
                out.done()
                out = None
        finally:
            if out is not None:
                out.drop()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    os.makedirs(root, exist_ok=True)
    named = rows.sortWithinPartitions(key).select(F.col(key).cast("string").alias("key"), F.col("value").cast("binary").alias("value"), F.col("times").cast("long").alias("times"))
    named.mapInArrow(fn, "n long").write.format("noop").mode("overwrite").save()


_PACKED = "run_date DATE, run_id STRING, kind STRING, content STRING"
_INDEX = "run_date DATE, run_id STRING, kind STRING, file STRING, n BIGINT"


def write_packed(rows: DataFrame, base: str, batch: int) -> None:
    """Artifacts of any number of runs in files of Spark's own size, with an index of the files that hold a run.

    ``rows``: ``run_date, run_id, kind, content``. They are dealt by ranges of date and run (a hash parts the rows of a
    large run), so a run lies in one file or in neighbouring ones and the number of files follows the bytes, not the
    runs. A batch that is written again replaces its own files and index.
    """
    spark = rows.sparkSession
    named = rows.select(F.col("run_date").cast("date").alias("run_date"), "run_id", "kind", "content")
    ranged = named.repartitionByRange("run_date", "run_id", F.xxhash64("kind", "content"))
    data = f"{base}/data/batch={batch}"
    ranged.sortWithinPartitions("run_id", "kind").write.mode("overwrite").parquet(data)
    written = spark.read.schema(_PACKED).parquet(data).select("*", F.col("_metadata.file_path").alias("file"))
    index = written.groupBy("run_date", "run_id", "kind", "file").agg(F.count(F.lit(1)).alias("n"))
    index.sort("run_id", "kind", "file").write.mode("overwrite").parquet(f"{base}/index/batch={batch}")


def packed_index(spark: SparkSession, base: str) -> DataFrame:
    """``run_date, run_id, kind, file, n, batch``: the files that hold each run's artifacts, and how many of them."""
    return spark.read.schema(f"{_INDEX}, batch INT").parquet(f"{base}/index")


def read_packed(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(f"{_PACKED}, batch INT").parquet(f"{base}/data")


def read_run(spark: SparkSession, base: str, run_id: str, kind: str | None = None) -> DataFrame:
    """One run's artifacts, from the files that the index names for it; the driver sees their names only."""
    wanted = F.col("run_id") == run_id
    if kind is not None:
        wanted &= F.col("kind") == kind
    files = [r.file for r in packed_index(spark, base).where(wanted).select("file").distinct().sort("file").collect()]
    if not files:
        return spark.createDataFrame([], _PACKED)
    return spark.read.schema(_PACKED).parquet(*files).where(wanted)


def pack_run_logs(manifests: DataFrame, index: DataFrame, errors: DataFrame, base: str, batch: int = 0) -> None:
    """The same as JSON texts in packed files: for runs too many to have a folder each.

    All three carry run_date and run_id.
    """
    content = lambda df: F.to_json(F.struct(*(c for c in df.columns if c not in ("run_date", "run_id"))))
    kind = lambda df, name: df.select("run_date", "run_id", F.lit(name).alias("kind"), content(df).alias("content"))
    rows = kind(manifests, "run_manifest").unionByName(kind(index, "resource_index")).unionByName(kind(errors, "error_log"))
    write_packed(rows, base, batch)


def export_tasks(json_rows: DataFrame, path: str, fmt: str) -> None:
    """Write exported tasks (column ``task``) as JSON lines or as one YAML document per row."""
    from pagemill.sources.readers import json_to_yaml

    if fmt == "json":
        json_rows.select("task").write.mode("overwrite").text(path)
    elif fmt == "yaml":
        document = F.rtrim(json_to_yaml(F.col("task")), F.lit("\n"))
        json_rows.select(F.concat(F.lit("---\n"), document)).write.mode("overwrite").text(path)
    else:
        raise ValueError("Format must be 'json' or 'yaml'")
