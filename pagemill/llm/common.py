"""What the corpus operators share: slices of Arrow batches, word arrays, tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import shared_dir

#: Words between ASCII white space.
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of ASCII letters, digits and everything beyond ASCII, over UTF-8 bytes with A-Z lower-cased.
LETTERED = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back.

    Cuts the lineage: what reads the result survives the loss of any executor. The shuffle
    files of the write go as soon as it has ended, since the table replaces them.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row. Bounds what a task holds."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        start, before = 0, 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Whole texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, which may start where it isn't installed. Once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_has_pagemill", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp()) / "pagemill.zip"  # read by the driver only, which serves it to executors
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(packed))
    sc._has_pagemill = True


def arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, text: str = "text", most: int = 1 << 20) -> DataFrame:
    """``mapInArrow`` of a function from one bounded slice to one batch."""
    return arrow(df, lambda batches: map(fn, slices(batches, text, most)), schema)


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """The names, with underscores behind those that ``df`` already has (case doesn't tell columns apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def add_columns(df: DataFrame, fn, fields: str, replace: list[str] | None = None, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``df`` with the columns that ``fn`` makes of each bounded slice, and their names.

    ``fields``: DDL of the new columns. Names that ``df`` has already get underscores, unless ``replace`` gives the
    columns that earlier calls made.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    new = _parse_datatype_string(fields).fields
    names = replace or free_names(df, [f.name for f in new])
    keep = [c for c in df.columns if not (replace and c in replace)]
    out = StructType([df.schema[c] for c in keep] + [StructField(n, f.dataType) for n, f in zip(names, new, strict=True)])
    types = list(to_arrow_schema(StructType(out.fields[len(keep) :])))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(fn(b), types, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(c) for c in keep] + made, names=keep + names)

    return map_slices(df, each, out, text), names


def running(ids: np.ndarray, n: int) -> np.ndarray:
    """One number for every window of ``n`` ids in a row, equal exactly where the windows are equal."""
    key = ids
    for k in range(1, n):
        key = np.unique(key, return_inverse=True)[1] if k > 1 or (len(ids) and ids.max() >= 1 << 31) else key
        follow = ids[k:]
        key = key[: len(follow)].astype(np.int64) * (int(ids.max()) + 1 if len(ids) else 1) + follow
    return key


def crc_of(column) -> F.Column:
    """Unsigned CRC-32 of a column as text; null is the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def sample_by_hash(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The ``rows`` rows of smallest key hash: the same ones however the table is partitioned."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(rows)


def examples(docs: DataFrame, labels: DataFrame, sample: int, fn) -> DataFrame:
    """``doc_id, text_hash, places, values, marks``: one row per labelled id and text, at most ``sample`` rows of smallest hash.

    ``labels``: ``doc_id`` and a label, one row per id, few enough to broadcast. ``fn`` makes places, values and marks
    of a bounded slice. Rows are chosen by narrow keys and features made where the texts lie, so neither the texts nor
    more than ``sample`` rows meet in one task, however often an id is repeated.
    """
    key = ["doc_id", "text_hash"]
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    narrow = hashed.select(*key).join(F.broadcast(labels), "doc_id").distinct()
    rows = hashed.join(F.broadcast(sample_by_hash(narrow, sample, *key)), key)

    def each(batches):
        seen: set = set()  # at most ``sample`` keys
        for b in slices(batches):
            new = []
            for n, pair in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), strict=True)):
                if pair not in seen:
                    seen.add(pair)
                    new.append(n)
            if new:
                b = b.take(pa.array(new))
                yield batch_of(schema, b.column("doc_id"), b.column("text_hash"), *fn(b))

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("places", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("marks", pa.list_(pa.int32()))])
    made = arrow(rows, each, "doc_id long, text_hash long, places array<int>, values array<double>, marks array<int>")
    return made.dropDuplicates(key)


def in_one_task(found: DataFrame) -> DataFrame:
    """``examples`` in a fixed order for the task that fits."""
    return found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "text_hash")


def pairs_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each row of ``examples``."""
    return [(p.values.to_numpy().astype(np.int64), v.values.to_numpy()) for p, v in zip(batch.column("places"), batch.column("values"), strict=True)]
