"""Quality classifier: hashed word n-grams, logistic regression by FTRL, scored as sparse dot products.

A word is a run of letters, of digits or of signs, case kept. Single words and pairs hash into ``2**BITS`` places, pairs
of one word twice into one place for all words; a place's value is log(1 + count), the vector has length one.

Learned from a bounded sample of the labelled rows that aren't held out (``SAMPLE`` ids of smallest hash, and of their
different texts again ``SAMPLE``), made into features where they lie and fitted in one task; only non-zero weights reach
the driver. Scoring covers every whole text and shuffles nothing.

Edge cases: null, empty and wordless texts have the intercept's score; null labels are left out; without labels all
scores are 0.5; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import add_columns, arrow, crc_of, examples, in_one_task, pairs_of, sample_by_hash, texts
from pagemill.llm.linear import Hashes, fit, sigmoid

BITS = 20
SAMPLE = 4_000
#: Label 1 from this score on.
GOOD = 0.7

_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def features(text: str, hashes: Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.of(_WORDS.findall(text))
    top = (1 << bits) - 1
    pairs = (h[:-1] * 0x9E3779B1 + h[1:] * 0x85EBCA6B) >> 7
    pairs[h[:-1] == h[1:]] = 1  # a word said again is one and the same pair, whatever the word
    again = np.full(int((h[:-2] == h[2:]).sum()), 2)
    places, count = np.unique(np.concatenate([h, pairs, again]) % top, return_counts=True)
    value = np.log1p(count)
    value /= max(1e-9, float(np.sqrt(value @ value)))
    return np.append(places, top), np.append(value, 1.0)


def held_out(doc_id="doc_id"):
    return crc_of(F.col(doc_id)) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights from ``labels`` (``doc_id, quality``), held-out rows left aside, and the labelled texts."""
    usable = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = sample_by_hash(usable, sample, "doc_id")

    def made(b: pa.RecordBatch) -> tuple:
        hashes = Hashes()
        found = [features(t, hashes, bits) for t in texts(b)]
        return [x for x, _ in found], [x for _, x in found], [[y] for y in b.column("quality").to_pylist()]

    def fn(batches):
        found, y = [], []
        for b in batches:
            found += pairs_of(b)
            y += [x[0] for x in b.column("marks").to_pylist()]
        if found:
            w = fit(1 << bits, found, y, alpha=1.0, l1=0.3, l2=0.01)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], names=["place", "weight"])

    weights = np.zeros(1 << bits)
    for r in arrow(in_one_task(examples(docs, ids, sample, made)), fn, "place int, weight double").collect():  # at most 2**bits rows
        weights[r["place"]] = r["weight"]
    return weights


def scored(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> tuple[DataFrame, str]:
    """``docs`` with the probability of label 1; and the new column's name."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers
    hashes = Hashes()

    def fn(b: pa.RecordBatch) -> list:
        w = shared.value
        found = [features(t, hashes, bits) for t in texts(b)]
        return [pa.array(sigmoid(np.array([w[i] @ v for i, v in found])))]

    df, names = add_columns(docs, fn, "quality_score double")
    return df, names[0]


def op7_hashed_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, name = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out().alias("held_out"), F.col(name).alias("score"), (F.col(name) >= GOOD).cast("int").alias("predicted"))
