"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

One pass over the texts makes a narrow table of statistics. The trees are fitted on a bounded sample of the labelled
rows (``SAMPLE`` of smallest hash, statistics only) with monotonic constraints: more symbols, repeated words, repeated
lines or capitals never raise a score. Their nodes lie in flat numpy arrays, and each task scores whole batches of rows.

Edge cases: null, empty and wordless texts have zero statistics and fail the base rules; labels that are null are left
out; with no labels, or one kind only, the score is the share of good labels (0.5 for none); repeated rows are judged
each; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import gbt
from pagemill.llm.common import SPACED, arrow, batch_of, map_slices, running, sample_by_hash, stored, texts

#: Labelled rows that the trees are fitted on.
SAMPLE = 20_000
#: Kept from this score on.
KEEP = 0.5
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"

_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
_UPPER = re.compile(r"[A-Z]")

#: Statistics of a text and, for the shares made of them, the way a score may move.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_lines", "n_twins", "n_ends")
SHARES = (("log_words", 0), ("word_length", 0), ("symbols", -1), ("dup_lines", -1), ("repeats", -1), ("distinct", 0), ("capitals", -1), ("line_length", 0), ("twins", -1), ("ends", 0))


def statistics(text: str) -> tuple[int, ...]:
    words = SPACED.findall(text)
    n = len(words)
    if not n:
        return (0,) * len(STATS)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeated = 0
    if n > 3:
        windows, at, count = np.unique(running(ids, 3), return_inverse=True, return_counts=True)
        if len(windows) < n - 2:
            cover = np.zeros(n + 3, np.int64)
            twice = np.flatnonzero(count[at] > 1)
            cover[twice] += 1
            np.subtract.at(cover, twice + 3, 1)
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    lines = [x for x in text.split("\n") if _HAS_WORD.search(x)]
    return (
        n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(known),
        len(text) - len(_UPPER.sub("", text)), len(lines), int((ids[1:] == ids[:-1]).sum()), text.count(".") + text.count("!") + text.count("?"),
    )


def shares(stats: np.ndarray) -> np.ndarray:
    """The trees' features from rows of statistics."""
    s = stats.astype(float)
    words, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 7], 1)
    return np.stack([np.log1p(s[:, 0]), chars / words, s[:, 2] / words, s[:, 3] / lines, s[:, 4] / words, s[:, 5] / words, s[:, 6] / chars, words / lines, s[:, 8] / words, s[:, 9] / words], 1)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([statistics(t) for t in texts(b)], np.int64).reshape(-1, len(STATS))
        return batch_of(schema, b.column("doc_id"), *[pa.array(rows[:, k]) for k in range(len(STATS))])

    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in STATS]])
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, "doc_id long, " + ", ".join(f"{n} long" for n in STATS))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> gbt.Forest:
    """Trees from ``labels`` (``doc_id, quality``) and the statistics; ``sample`` narrow rows reach the driver."""
    ids = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    one = stats.join(F.broadcast(sample_by_hash(ids, sample, "doc_id")), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), *[F.max(n).alias(n) for n in STATS])
    rows = np.array([tuple(r) for r in one.orderBy("doc_id").collect()], np.int64).reshape(-1, 2 + len(STATS))
    return gbt.fit(shares(rows[:, 2:]), rows[:, 1], [s for _, s in SHARES])


def judged(stats: DataFrame, forest: gbt.Forest, keep: float = KEEP) -> DataFrame:
    """The statistics with ``base_failed``, ``score`` and ``kept``."""

    def fn(batches):
        for b in batches:
            s = np.stack([b.column(n).to_numpy() for n in STATS], 1) if b.num_rows else np.zeros((0, len(STATS)), np.int64)
            failed = (s[:, 0] < LEAST_WORDS) | (100 * s[:, 4] > 50 * s[:, 0])
            score = forest.score(shares(s))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep))], names=[*b.schema.names, "base_failed", "score", "kept"])

    return arrow(stats, fn, "doc_id long, " + ", ".join(f"{n} long" for n in STATS) + ", base_failed boolean, score double, kept boolean")


def op1_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "document-statistics")
    return judged(stats, train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", *STATS[:5], "base_failed", "kept", "score")
