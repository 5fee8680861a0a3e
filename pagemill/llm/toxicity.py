"""Toxicity by a classifier chain: categories one after the other, each seeing the probabilities of those before.

Features are hashed words and their beginnings (5 and 6 letters, since insults take endings), with log(1 + count);
each link of the chain is a linear model whose last features are the earlier categories' probabilities. The categories
come from the labelled rows: toxic rows are grouped by what makes a model that did not see them call them toxic
(``kinds``), larger groups first; the last category is the label. In training the earlier probabilities come from models
that did not see the row (out of fold), so a later link learns from probabilities as good as those it gets when scoring.

Training rows are a bounded sample of the labelled ones (``SAMPLE`` ids of smallest hash, and of their different texts
again ``SAMPLE``), made into features where they lie and fitted in one task; only non-zero weights reach the driver.
Scoring covers every whole text and shuffles nothing.

Edge cases: null, empty and wordless texts score by the intercept alone; labels that are null are left out; without
labels, or with one kind only, all probabilities are those of an empty model (0.5 for none, else the kind seen), and
nothing is rejected without a toxic label; repeated rows are scored each; columns of any name are kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import LETTERED, add_columns, arrow, examples, in_one_task, pairs_of, raw_texts, sample_by_hash
from pagemill.llm.linear import fit, sigmoid

#: Kinds of toxic rows that are told apart; the chain's last link is the label itself.
KINDS = 2
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
SAMPLE = 8_000
FOLDS = 3
#: Of every link's updates.
FIT = {"epochs": 3, "alpha": 1.0, "l1": 2.0, "l2": 0.1}
BITS = 20
#: Letters of the beginnings of longer words.
BEGINNINGS = (5, 6)
#: Rejected from this probability of the last category on.
REJECT = 0.3


class Words(dict):
    """Word to the row of its features in a table that grows; starts anew when it is full."""

    def __init__(self, bits: int = BITS, most: int = 200_000):
        super().__init__()
        self.top, self.most = (1 << bits) - 16, most
        self.table = np.zeros((1024, 1 + len(BEGINNINGS)), np.int64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        letters = word.decode()
        self.table[n] = [zlib.crc32(word) % self.top] + [zlib.crc32(b"%d" % k + letters[:k].encode()) % self.top if len(letters) > k else -1 for k in BEGINNINGS]
        self[word] = n
        return n


def features(text: bytes, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and values; the last sixteen places of the range are kept free."""
    if len(known) > known.most:
        known.clear()
    words = LETTERED.findall(text.lower())
    rows = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    places, count = np.unique(known.table[rows], return_counts=True)
    some = places >= 0
    return places[some], np.log1p(count[some])


def _example(found: tuple[np.ndarray, np.ndarray], earlier: list[float], bits: int) -> tuple[np.ndarray, np.ndarray]:
    top = (1 << bits) - 16
    return np.append(found[0], np.arange(top, top + 1 + len(earlier))), np.concatenate([found[1], [1.0], earlier])


def fit_chain(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[np.ndarray], folds: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Weights of each link; ``labels``: one array of 0 and 1 per category."""
    earlier: list[list[float]] = [[] for _ in rows]
    chain = []
    for k, y in enumerate(labels):
        examples = [_example(i, e, bits) for i, e in zip(rows, earlier, strict=True)]
        chain.append(fit(1 << bits, examples, y, **FIT))
        if k + 1 < len(labels):
            for f in range(FOLDS):
                inside = np.flatnonzero(folds != f)
                w = fit(1 << bits, [examples[i] for i in inside], y[inside], **FIT)
                for i in np.flatnonzero(folds == f):
                    earlier[i].append(_probability(w, *examples[i]))
    return chain


def _probability(w: np.ndarray, idx: np.ndarray, value: np.ndarray) -> float:
    return float(sigmoid(w[idx] @ value))


def score_chain(chain: list[np.ndarray], found: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> list[float]:
    out: list[float] = []
    for w in chain:
        out.append(_probability(w, *_example(found, out, bits)))
    return out


def kinds(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, folds: np.ndarray, bits: int = BITS, rounds: int = 10) -> list[np.ndarray]:
    """Toxic rows in ``KINDS`` groups, one array of 0 and 1 each.

    A row is described by its features' pushes towards toxic in a model that did not see it, scaled to length one. Centres
    start at the row pushed hardest and at those least like the centres so far, and move to their rows' mean direction.
    """
    marks = [np.zeros(len(rows), np.int64) for _ in range(KINDS)]
    pushed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    force: dict[int, float] = {}
    for f in range(FOLDS):
        inside, outside = np.flatnonzero(folds != f), np.flatnonzero((folds == f) & (toxic == 1))
        w = fit(1 << bits, [_example(rows[i], [], bits) for i in inside], toxic[inside], **FIT) if len(inside) and len(outside) else None
        for i in outside.tolist():
            push = np.maximum(w[rows[i][0]] * rows[i][1], 0)
            force[i] = float(np.sqrt(push @ push))
            pushed[i] = (rows[i][0], push / (force[i] or 1.0))
    if not pushed:
        return marks
    ids = sorted(pushed)
    like = lambda centre: np.array([centre[pushed[i][0]] @ pushed[i][1] for i in ids])
    centres: list[np.ndarray] = []
    while len(centres) < KINDS:
        first = int(np.argmin(np.max([like(c) for c in centres], axis=0))) if centres else int(np.argmax([force[i] for i in ids]))
        centres.append(np.zeros(1 << bits))
        centres[-1][pushed[ids[first]][0]] = pushed[ids[first]][1]
    for _ in range(rounds):
        nearest = np.argmax([like(c) for c in centres], axis=0)
        for k, c in enumerate(centres):
            c[:] = 0
            for i in np.flatnonzero(nearest == k).tolist():
                c[pushed[ids[i]][0]] += pushed[ids[i]][1]
            c /= np.sqrt(c @ c) or 1.0
    sizes = np.bincount(nearest, minlength=KINDS)
    for place, k in enumerate(np.argsort(-sizes, kind="stable")):
        marks[place][np.array(ids)[nearest == k]] = 1
    return marks


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> list[np.ndarray]:
    """The chain's weights from ``labels`` (``doc_id, toxic``) and the labelled texts of ``docs``."""
    ids = sample_by_hash(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), sample, "doc_id")

    def made(b: pa.RecordBatch) -> tuple:
        known, found, marks = Words(bits), [], []
        for text, y in zip(raw_texts(b), b.column("toxic").to_pylist(), strict=True):
            found.append(features(text, known))
            marks.append([int(bool(y))])
        return [x for x, _ in found], [x for _, x in found], marks

    def fn(batches):
        found, marks, ids = [], [], []
        for b in batches:
            found += pairs_of(b)
            marks += b.column("marks").to_pylist()
            ids += b.column("doc_id").to_pylist()
        if not found:
            return
        y, folds = np.array(marks)[:, 0], np.array(ids) // 7 % FOLDS
        for k, w in enumerate(fit_chain(found, [*kinds(found, y, folds, bits), y], folds, bits)):
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(w[at])], names=["link", "place", "weight"])

    chain = [np.zeros(1 << bits) for _ in CATEGORIES]
    for r in arrow(in_one_task(examples(docs, ids, sample, made)), fn, "link int, place int, weight double").collect():  # non-zero weights: at most 2**bits a link
        chain[r["link"]][r["place"]] = r["weight"]
    return chain


def scored(docs: DataFrame, chain: list[np.ndarray], bits: int = BITS) -> tuple[DataFrame, list[str]]:
    """``docs`` with a probability for each category; and the new columns' names."""
    shared = docs.sparkSession.sparkContext.broadcast([(np.flatnonzero(w), w[np.flatnonzero(w)]) for w in chain])
    made: list = []

    def fn(b: pa.RecordBatch) -> list:
        if not made:
            for at, w in shared.value:
                made.append(np.zeros(1 << bits))
                made[-1][at] = w
            made.append(Words(bits))
        p = [score_chain(made[:-1], features(t, made[-1]), bits) for t in raw_texts(b)]
        return [pa.array([x[k] for x in p], pa.float64()) for k in range(len(CATEGORIES))]

    return add_columns(docs, fn, ", ".join(f"p_{name} double" for name in CATEGORIES))


def clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents that the chain doesn't find toxic, with the columns they came with."""
    found, names = scored(docs, train(docs, labels))
    return found.where(~_rejected(names[-1], reject)).select(*docs.columns)


def _rejected(name: str, reject: float):
    return F.col(name) > reject


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, names = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", *names, _rejected(names[-1], REJECT).alias("toxic"))
