"""Benchmark decontamination by suffix arrays of the training texts.

Every slice of documents is a shard: its words become one stream of numbers, of which a suffix array is built; every
suffix of every benchmark item is binary-searched in it, word by word, for all suffixes at once. That gives the longest
verbatim match of each suffix and the range of the suffix array where it stands; matches as long as a window mark the
document's words as hit. Places are marked by ranges and common prefixes, pairs of places are never listed, so a word
repeated a million times in a text costs no more than other words. Searching takes time by the summed length of the
matches of each block's suffixes, whatever the number of places.

What can't hold a window is left out before sorting, exactly: words that no item has end a run, and runs shorter than
the shortest window hold none. Suffixes are sorted on as many words as the longest item has.

The benchmark is the stated query set. It goes to the tasks in blocks of at most ``BLOCK`` bytes of text; a larger one
costs one more pass over the documents for each block. Nothing is shuffled.

Edge cases: null texts and texts without words have no words and are never contaminated; items without id or words are
ignored, items of one id count once and ids may have any type; without items nothing is hit; repeated rows each get
their result; columns of any name are kept. A text longer than a slice is a shard of its own.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import LETTERED, add_columns, raw_texts, stored

#: Words of a window; a shorter item is one window.
WINDOW = 13
#: Bytes of item text in a block of the benchmark.
BLOCK = 8 << 20
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20


class Suffixes:
    """All suffixes of a block of items as word numbers; number 0 is any word that the block doesn't have."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        self.names: list = []
        stream: list[int] = []
        item, left = [], []
        for name, text in items:
            found = LETTERED.findall(text.lower())
            if not found:
                continue
            stream += [self.words.setdefault(w, len(self.words) + 1) for w in found]
            item += [len(self.names)] * len(found)
            left += range(len(found), 0, -1)
            self.names.append(name)
        self.stream = np.array(stream, np.int64)
        self.item, self.left = np.array(item, np.int64), np.array(left, np.int64)
        size = np.bincount(self.item, minlength=len(self.names))
        self.need = np.minimum(window, size)[self.item] if len(item) else self.left
        self.window = window
        self.longest = int(size.max()) if len(size) else 0
        self.shortest = int(self.need.min()) if len(item) else 0


def suffix_array(stream: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Starts of the suffixes in order of their first ``depth`` words, by doubling; and each step's words and ranks."""
    rank, k = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    ranks = [(k, rank)]
    while k < depth:
        key = rank * (len(stream) + 1)
        key[:-k] += rank[k:] + 1
        values, rank = np.unique(key, return_inverse=True)
        k *= 2
        ranks.append((k, rank))
        if len(values) == len(stream):
            break
    return np.argsort(rank, kind="stable"), ranks


def shared_words(order: np.ndarray, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Words that each suffix has in common with the one before it in order (0 for the first), as far as was sorted."""
    a, b = order[:-1].copy(), order[1:].copy()
    same = np.zeros(len(order), np.int64)
    for k, rank in reversed(ranks):
        inside = np.flatnonzero(np.maximum(a, b) < len(order))
        equal = inside[rank[a[inside]] == rank[b[inside]]]
        a[equal] += k
        b[equal] += k
        same[equal + 1] += k
    return same


def _carry(value: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Running ``max(value[i], min(result[i - 1], limit[i]))``, in log n steps."""
    value, limit, step = value.copy(), limit.copy(), 1
    while step < len(value) and limit.any():
        value[step:], limit[step:] = np.maximum(value[step:], np.minimum(value[:-step], limit[step:])), np.minimum(limit[step:], limit[:-step])
        step *= 2
    return value


def search(stream: np.ndarray, order: np.ndarray, q: Suffixes):
    """For every suffix of the items: length of its longest match, and the ranges of ``order`` for it and for its window.

    All suffixes go one word deeper together; a bisection inside each one's range finds the next range.
    """
    n, m = len(stream), len(q.stream)
    padded = np.concatenate([stream, np.zeros(q.longest + 1, np.int64)])
    low, high = np.zeros(m, np.int64), np.full(m, n)
    length, window_low, window_high = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    active = np.arange(m)
    depth = 0
    while len(active):
        active = active[q.left[active] > depth]
        word = q.stream[active + depth]
        a = _bisect(padded, order, depth, low[active], high[active], word, False)
        b = _bisect(padded, order, depth, a, high[active], word, True)
        some = b > a
        active, depth = active[some], depth + 1
        low[active], high[active], length[active] = a[some], b[some], depth
        there = active[q.need[active] == depth]
        window_low[there], window_high[there] = low[there], high[there]
    return length, low, high, window_low, window_high


def _bisect(padded, order, depth, low, high, word, right):
    low, high = low.copy(), high.copy()
    while len(at := np.flatnonzero(low < high)):
        middle = (low[at] + high[at]) >> 1
        value = padded[order[middle] + depth]
        up = value <= word[at] if right else value < word[at]
        low[at[up]] = middle[up] + 1
        high[at[~up]] = middle[~up]
    return low


class Shard:
    """The words of some documents that may hold a window, as one stream; ``doc`` and ``place`` say where each stands."""

    def __init__(self, docs: list[bytes], q: Suffixes):
        get = q.words.get
        numbers, sizes = [], []
        for t in docs:
            found = LETTERED.findall(t.lower())
            numbers.append(np.fromiter(map(get, found, repeat(0)), np.int64, len(found)))
            numbers.append(np.zeros(1, np.int64))
            sizes.append(len(found))
        self.sizes = np.array(sizes, np.int64)
        every = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        edge = np.diff(np.concatenate([[0], (every > 0).astype(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        wide = stop - start >= max(1, q.shortest)
        start, stop = start[wide], stop[wide] + 1  # with the 0 behind it, which no item's word equals
        size = stop - start
        where = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        self.stream = every[where]
        first = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.doc = np.searchsorted(first, where, "right") - 1
        self.place = where - first[self.doc]


def _sets(low: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For windows numbered 0, 1, ...: which of the distinct sets of items each one has, and those sets."""
    by = np.unique(np.stack([low, item], 1), axis=0)
    known: dict[bytes, int] = {}
    sets, which = [], []
    for part in np.split(by[:, 1], np.flatnonzero(np.diff(by[:, 0])) + 1):
        number = known.setdefault(part.tobytes(), len(known))
        if number == len(sets):
            sets.append(part)
        which.append(number)
    return np.array(which, np.int64), sets


def matches(shard: Shard, q: Suffixes) -> tuple[list[tuple[int, int, int]], dict[int, set[int]], dict[int, int]]:
    """Spans hit (document, first word, word behind), items by document, words of the longest match by document.

    Windows of one length have disjoint ranges of the suffix array: each rank lies in one of them at most. The longest
    match of a place is that of the nearest rank where a search ended, cut to the words shared up to there.
    """
    spans, items, longest = [], {}, {}
    n = len(shard.stream)
    if not n or not len(q.stream):
        return spans, items, longest
    order, ranks = suffix_array(shard.stream, q.longest)
    length, low, _, window_low, window_high = search(shard.stream, order, q)
    found = np.flatnonzero(window_high > window_low)
    if not len(found):
        return spans, items, longest
    edge, best = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    for k in np.unique(q.need[found]).tolist():
        some = found[q.need[found] == k]
        start, one, number = np.unique(window_low[some], return_index=True, return_inverse=True)
        stop = window_high[some][one]
        window = np.searchsorted(start, np.arange(n), "right") - 1
        rank = np.flatnonzero((window >= 0) & (np.arange(n) < stop[window]))
        place = order[rank]
        edge[place] += 1
        edge[place + k] -= 1
        if k == q.window:
            ends = np.zeros(n, np.int64)
            np.maximum.at(ends, low[some], length[some])
            same = shared_words(order, ranks)
            ends = np.maximum(_carry(ends, same), _carry(ends[::-1], np.concatenate([[0], same[1:][::-1]]))[::-1])
            best[rank] = np.maximum(best[rank], ends[rank])
        else:
            best[rank] = np.maximum(best[rank], k)
        which, sets = _sets(number, q.item[some])
        for d, s in np.unique(np.stack([shard.doc[place], which[window[rank]]], 1), axis=0).tolist():
            items.setdefault(d, set()).update(sets[s].tolist())
    hit = np.diff(np.concatenate([[0], np.cumsum(edge[:n]) > 0, [0]]).astype(np.int8))
    first, last = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1) - 1
    spans = list(zip(shard.doc[first].tolist(), shard.place[first].tolist(), (shard.place[last] + 1).tolist(), strict=True))
    most = np.zeros(len(shard.sizes), np.int64)
    np.maximum.at(most, shard.doc[order], best)
    return spans, items, {d: int(most[d]) for d in items}


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "n_words long, spans array<struct<start:long,stop:long>>, items array<{}>, longest long"


def blocks_of(benchmark: DataFrame, most: int = BLOCK):
    """The benchmark in blocks of items; the driver holds one block and one partition of the items at a time."""
    held, size = [], 0
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    for name, text in rows.toLocalIterator():
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append((name, bytes(text)))
        size += len(text)
    yield held


def _annotate(docs: DataFrame, block, ids: str, names: list[str] | None, window: int) -> tuple[DataFrame, list[str]]:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK bytes, or one item
    made: list[Suffixes] = []

    def fn(batch: pa.RecordBatch) -> list:
        if not made:
            made.append(Suffixes(shared.value, window))
        q = made[0]
        shard = Shard(raw_texts(batch), q)
        rows = batch.num_rows
        spans, items, longest = [[] for _ in range(rows)], [set() for _ in range(rows)], [0] * rows
        if names:
            for i, (s, t, m) in enumerate(zip(*(batch.column(n).to_pylist() for n in names[1:]), strict=True)):
                spans[i], items[i], longest[i] = [(x["start"], x["stop"]) for x in s], set(t), m
        new, named, most = matches(shard, q)
        for d, start, stop in new:
            spans[d].append((start, stop))
        for d, found in named.items():
            items[d].update(q.names[i] for i in found)
            longest[d] = max(longest[d], most[d])
        merged = [[{"start": a, "stop": b} for a, b in merge_spans(s)] if s else [] for s in spans]
        return [shard.sizes, merged, [sorted(x) for x in items], longest]

    return add_columns(docs, fn, _FOUND.format(ids), replace=names)


def located(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """``docs`` with words, hit spans (in words), items and the longest verbatim match; and the four new columns' names."""
    names: list[str] | None = None
    ids = benchmark.schema["item_id"].dataType.simpleString()
    for i, part in enumerate(blocks_of(benchmark, block)):
        docs, names = _annotate(stored(docs, "decontaminated") if i else docs, part, ids, names, window)
    return docs, names


def _hit(spans: str):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def _contaminated(words: str, spans: str, share: int):
    return (_hit(spans) > 0) & (share * _hit(spans) >= F.col(words))


def clean(docs: DataFrame, benchmark: DataFrame, share: int = SHARE) -> DataFrame:
    """The documents that aren't contaminated, with the columns they came with."""
    found, (words, spans, _, _) = located(docs, benchmark)
    return found.where(~_contaminated(words, spans, share)).select(*docs.columns)


def op2_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, (words, spans, items, longest) = located(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.transform(F.col(items), lambda x: x.cast("string")))
    return found.select(
        "doc_id", F.col(words).alias("n_words"), _hit(spans).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), _contaminated(words, spans, SHARE).alias("contaminated"),
        F.col(longest).alias("longest_match"),
    )


#: Windows joined with the windows of the documents; islands of hit words. ``longest_match`` by growing runs on diagonals.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT item_id, s, least(13, len(w)) AS k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT d.doc_id, d.w, z.k, unnest(range(1, len(d.w) - z.k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw) z WHERE len(d.w) >= z.k)),
hits AS (SELECT dw.doc_id, dw.p, dw.k, bw.item_id, bw.s FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n_hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS x FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1),
runs AS (SELECT doc_id, item_id, p - s AS diagonal, k, p - row_number() OVER (PARTITION BY doc_id, item_id, p - s ORDER BY p) AS island FROM hits),
longest AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) + k - 1 AS n FROM runs GROUP BY doc_id, item_id, diagonal, island, k) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(named.s, '')) AS items_sha256,
  coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(d.w) AS contaminated, coalesce(longest.n, 0)::BIGINT AS longest_match
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
