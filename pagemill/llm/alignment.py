"""Alignment of two tokenizers: which of their tokens overlap in the same bytes, and how many documents link each pair.

Texts are encoded once by both and kept as tables of ids. Wherever tokens of both end at the same byte, a group ends; two
tokens are linked if their byte ranges overlap. Ends and links of a whole slice of documents come from sorted searches.

A first pass over the ids gives the distinct linked pairs. They are dealt to segments by hash, and one task makes a
minimal perfect hash of each: levels of bitmaps in which every pair alone at its place sets a bit, the others go on to
the next level; a pair's number is the count of bits before its own. The pairs stand in that order as keys, so that a
number is verified against the pair itself. Each task then counts documents into dense vectors indexed by the hash, in
chunks of the narrowest fitting integers; chunks are summed in a tree of ``FAN`` at a time. The second pass aligns the
documents again and looks up the counts.

Tables that go to the workers hold one entry per distinct pair; pairs are bounded by the two vocabularies, and go round
in groups of at most ``GROUP`` pairs, each group costing one more pass over the ids.

Edge cases: null and empty texts, and those whose tokens don't give the text's bytes back, have no tokens and zeros;
texts of any length are taken whole; repeated rows each count as a document and get their result; ties for an id's
highest count all count as best; an empty table gives an empty result; ids may be of any type, other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.bpe import SPLIT, byte_letters, vocabulary
from pagemill.llm.common import arrow, slices, stored, table, texts

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of a segment, of a group of segments that workers hold at a time, and of a chunk of a vector.
SEGMENT, GROUP, CHUNK = 1 << 20, 1 << 23, 1 << 16
#: Vectors summed by one task.
FAN = 16
#: Places of a level for each of its pairs.
ROOM = 2
#: Distinct pairs that a task holds before it hands them on.
HOLD = 1 << 22

_LONG = re.compile(r"\S{1000}|\s{1000}")


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 + 1 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Perfect:
    """A minimal perfect hash of distinct numbers, with the numbers in its order as verified keys."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.levels, self.keys = levels, keys
        self.before, n = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            ends = np.cumsum(ones)
            self.before.append(n + ends - ones)
            n += int(ends[-1])

    @staticmethod
    def build(numbers: np.ndarray) -> Perfect:
        left, levels, placed = numbers.astype(np.uint64), [], []
        while len(left):
            size = -(-len(left) * ROOM // 64) * 64
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            words = np.zeros(size // 64, np.uint64)
            np.bitwise_or.at(words, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            levels.append(words)
            placed.append(left[alone][np.argsort(at[alone])])
            left = left[~alone]
        return Perfect(levels, np.concatenate(placed).astype(numbers.dtype) if placed else numbers[:0])

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number; -1 for those that aren't keys."""
        out = np.full(len(numbers), -1, np.int64)
        open_ = np.arange(len(numbers))
        wide = numbers.astype(np.uint64)
        for k, words in enumerate(self.levels):
            if not len(open_):
                break
            at = (mix(wide[open_], k) % np.uint64(len(words) * 64)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[k][at[hit] >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        found = np.flatnonzero(out >= 0)
        wrong = self.keys[out[found]] != numbers[found]
        out[found[wrong]] = -1
        return out


class Segments:
    """Perfect hashes of several segments as one: a number's segment by its hash, places behind those of the segments before."""

    def __init__(self, parts: dict[int, Perfect], total: int):
        self.parts, self.total, self.first, n = parts, total, {}, 0
        for s in sorted(parts):
            self.first[s] = n
            n += len(parts[s].keys)
        self.size = n

    def find(self, numbers: np.ndarray) -> np.ndarray:
        if self.total == 1:
            return self.parts[0].find(numbers) if 0 in self.parts else np.full(len(numbers), -1, np.int64)
        out, of = np.full(len(numbers), -1, np.int64), segment_of(numbers, self.total)
        for s, part in self.parts.items():
            at = np.flatnonzero(of == s)
            place = part.find(numbers[at])
            out[at] = np.where(place < 0, -1, place + self.first[s])
        return out


def segment_of(numbers: np.ndarray, total: int) -> np.ndarray:
    return (mix(numbers.astype(np.uint64), 977) % np.uint64(total)).astype(np.int32)


class Vocabularies:
    """Both tokenizers, and the bytes of their tokens as offset tables."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.quick = self._by_rank(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocab = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        for word, i in vocab.items():
            self.a_bytes[i] = word.encode() if word in special else bytes(letters[c] for c in word)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = len(self.a_bytes), len(self.b_bytes)

    def _piece(self, i: int) -> bytes:
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    @staticmethod
    def _by_rank(path: str):
        """The same encoder by token rank, which is faster; none if the file does more than merge bytes in the order of its ids."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters, split = spec["model"]["vocab"], byte_letters(), spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        special = {t["content"] for t in spec["added_tokens"]}
        words = {w: i for w, i in vocab.items() if w not in special}
        if not plain or made != sorted(set(made)) or len(words) != len(made) + 256 or {w for w in words if len(w) == 1} != set(letters):
            return None
        ranks = {bytes(letters[c] for c in w): i for w, i in words.items()}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _encode_a(self, items: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.a.encode_batch_fast(items, add_special_tokens=False)]
        # Pieces of thousands of signs take the library, whose merging isn't square in a piece.
        return [self.a.encode(t, add_special_tokens=False).ids if _LONG.search(t) else self.quick.encode_ordinary(t) for t in items]

    @functools.cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def encode(self, items: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text; none where the tokens don't give the text's bytes back."""
        a = self._encode_a([" " + t for t in items])
        b = self.b.encode(items, num_threads=1)
        for i, t in enumerate(items):
            whole = (" " + t).encode()
            if not t or b"".join(map(self.a_bytes.__getitem__, a[i])) != whole or b"".join(map(self.b_bytes.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b


@functools.lru_cache(maxsize=2)
def load(a_path: str | None, b_path: str | None) -> Vocabularies:
    """Once per worker process."""
    return Vocabularies(a_path or vocabulary(A_FILE), b_path or vocabulary(B_FILE))


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, a, b``: ids of both tokenizers as little-endian integers."""
    from pyspark.sql.pandas.types import to_arrow_type

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(a_path, b_path)
        for s in slices(batches):
            a, b = v.encode(texts(s))
            columns = [pa.array([np.array(x, _width(n)).tobytes() for x in ids], pa.binary()) for ids, n in ((a, v.a_size), (b, v.b_size))]
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), *columns], schema=schema)

    kind = docs.schema[key].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("a", pa.binary()), ("b", pa.binary())])
    return arrow(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), fn, f"doc_id {kind.simpleString()}, a binary, b binary")


class Aligned:
    """Groups and links of a slice's documents, which stand one behind the other as one run of bytes."""

    def __init__(self, batch: pa.RecordBatch, v: Vocabularies):
        ids, self.first = [], []
        for name, size in (("a", v.a_size), ("b", v.b_size)):
            raw, kind = batch.column(name).to_pylist(), np.dtype(_width(size))
            ids.append(np.frombuffer(b"".join(raw), kind).astype(np.int64))
            self.first.append(np.concatenate([[0], np.cumsum([len(x) // kind.itemsize for x in raw])]))
        self.a, self.b = ids
        self.a_end, self.b_end = np.cumsum(v.lengths[0][self.a]), np.cumsum(v.lengths[1][self.b])
        self.n = batch.num_rows

    @functools.cached_property
    def a_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first[0]))

    @functools.cached_property
    def group_ends(self) -> np.ndarray:
        return np.intersect1d(self.a_end, self.b_end, assume_unique=True)

    @functools.cached_property
    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the linked tokens, in the order of the first tokenizer."""
        start = np.concatenate([[0], self.a_end[:-1]]) if len(self.a) else self.a_end
        low = np.searchsorted(self.b_end, start, "right")
        high = np.searchsorted(self.b_end, self.a_end, "left") + 1
        count = high - low
        left = np.repeat(np.arange(len(self.a)), count)
        offset = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        return left, low[left] + offset

    def pairs(self, v: Vocabularies) -> tuple[np.ndarray, np.ndarray]:
        """Document and pair number of every link."""
        left, right = self.links
        return self.a_doc[left], self.a[left] * v.b_size + self.b[right]

    def groups(self, v: Vocabularies) -> tuple[np.ndarray, list[str]]:
        """Number and digest of each document's groups."""
        ends, sizes = self.group_ends, [np.diff(f) for f in self.first]
        ga, gb = np.searchsorted(ends, self.a_end, "left"), np.searchsorted(ends, self.b_end, "left")
        side = np.concatenate([2 * ga, 2 * gb + 1])
        order = np.argsort(side, kind="stable")
        side, number = side[order], np.concatenate([self.a, self.b])[order]
        last = np.ones(len(side), bool)
        last[:-1] = side[1:] != side[:-1]
        sign = np.where(last, np.where(side & 1, 2, 1), 0)
        written = _numerals(max(v.a_size, v.b_size))[sign, number].tolist()
        stop = np.cumsum(sizes[0] + sizes[1])
        digest = ["".join(written[z - n : z])[:-1] for z, n in zip(stop.tolist(), (sizes[0] + sizes[1]).tolist(), strict=True)]
        doc_of_group = self.a_doc[np.searchsorted(self.a_end, ends, "left")]
        return np.bincount(doc_of_group, minlength=self.n), [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in digest]


@functools.lru_cache(maxsize=1)
def _numerals(size: int) -> np.ndarray:
    """Numbers as text before a comma, a bar and a semicolon."""
    return np.array([[f"{i}{c}" for i in range(size)] for c in ",|;"], object)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the id table: about 1 MB of ids, or one document."""
    return slices(batches, "a", 1 << 18)


def distinct_pairs(ids: DataFrame, a_path=None, b_path=None) -> DataFrame:
    """``pair``: the distinct linked pairs of all documents; each task hands on its own distinct ones."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held = load(a_path, b_path), np.zeros(0, np.int64)
        for s in _rows(batches):
            held = np.union1d(held, Aligned(s, v).pairs(v)[1])
            if len(held) > HOLD:
                yield pa.RecordBatch.from_arrays([pa.array(held)], names=["pair"])
                held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held)], names=["pair"])

    return arrow(ids.select("a", "b"), fn, "pair long").distinct()


def hashed(pairs: DataFrame, total: int) -> DataFrame:
    """``segment, level, words, keys``: the perfect hash of each segment, made by one task; keys stand at level 0."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            number = b.column("pair").to_numpy()
            of = b.column("segment").to_numpy()
            for s in np.unique(of):
                held.setdefault(int(s), []).append(number[of == s])
        for s, parts in held.items():
            made = Perfect.build(np.concatenate(parts))
            rows = [(s, k, w.tobytes(), made.keys.tobytes() if k == 0 else b"") for k, w in enumerate(made.levels)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["segment", "level", "words", "keys"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("pair"), pa.array(segment_of(b.column("pair").to_numpy(), total))], names=["pair", "segment"])

    dealt = arrow(pairs, deal, "pair long, segment int").repartition("segment")
    return arrow(dealt, fn, "segment int, level int, words binary, keys binary")


def collected(table: DataFrame, low: int, high: int, total: int) -> Segments:
    """The hashes of segments ``low`` to ``high`` (at most ``GROUP`` pairs) in the driver."""
    levels: dict[int, dict[int, np.ndarray]] = {}
    keys: dict[int, np.ndarray] = {}
    for r in table.where(F.col("segment").between(low, high - 1)).toLocalIterator():
        levels.setdefault(r["segment"], {})[r["level"]] = np.frombuffer(r["words"], np.uint64)
        if r["level"] == 0:
            keys[r["segment"]] = np.frombuffer(r["keys"], np.int64)
    return Segments({s: Perfect([x[k] for k in sorted(x)], keys[s]) for s, x in levels.items()}, total)


def _narrow(counts: np.ndarray) -> bytes:
    """A width byte and the counts in the narrowest integers."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(counts) or int(counts.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def counted(ids: DataFrame, shared, size: int, a_path=None, b_path=None) -> DataFrame:
    """``chunk, counts``: documents that link each pair, by place of the hash; tasks' vectors summed in a tree."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, find, sums = load(a_path, b_path), shared.value.find, np.zeros(size, np.int64)
        for s in _rows(batches):
            doc, pair = Aligned(s, v).pairs(v)
            number, at = np.unique(pair, return_inverse=True)
            once = np.unique(doc * len(number) + at) % len(number) if len(number) else at
            place = find(number)
            known = place >= 0
            sums[place[known]] += np.bincount(once, minlength=len(number))[known]
        part = TaskContext.get().partitionId()
        for chunk in range(-(-size // CHUNK)):
            here = sums[chunk * CHUNK : (chunk + 1) * CHUNK]
            if here.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part]), pa.array([_narrow(here)])], names=["chunk", "part", "counts"])

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = functools.reduce(np.add, (_wide(x.as_py()) for x in rows.column("counts")))
        return pa.table({"chunk": pa.array([key[0].as_py()]), "part": pa.array([key[1].as_py()]), "counts": pa.array([_narrow(total)])})

    made = stored(arrow(ids.select("a", "b"), fn, "chunk long, part long, counts binary"), "pair-vectors")
    parts = (made.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        made = made.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("chunk", "part").applyInArrow(add, "chunk long, part long, counts binary")
        parts = -(-parts // FAN)
        if parts <= 1:
            return made.select("chunk", "counts")


def _vector(chunks: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in chunks.toLocalIterator():  # one number for each pair of a group
        got = _wide(bytes(r["counts"]))
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(got)] = got
    return out


_OUT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text", segment: int = SEGMENT, group: int = GROUP) -> DataFrame:
    """``doc_id`` and the counts of each document's tokens, groups and links, with the corpus-wide counts of its pairs."""
    ids = stored(encoded(docs, a_path, b_path, key, text), "aligned-ids")
    pairs = stored(distinct_pairs(ids, a_path, b_path), "linked-pairs")
    total = max(1, -(-pairs.count() // segment))
    made = stored(hashed(pairs, total), "pair-hashes")
    step = max(1, group // segment)
    groups, best = [], {}
    for low in range(0, total, step):
        found = collected(made, low, low + step, total)
        shared = docs.sparkSession.sparkContext.broadcast(found)
        vector = _vector(stored(counted(ids, shared, found.size, a_path, b_path), "pair-counts"), found.size)
        groups.append((shared, vector))
        _highest(best, found, vector, load(a_path, b_path))
    return _looked_up(ids, groups, best, a_path, b_path)


def _highest(best: dict, found: Segments, vector: np.ndarray, v: Vocabularies) -> None:
    """Raise ``best``, the highest count of each id of the first tokenizer: bounded by its vocabulary."""
    top = best.setdefault("a", np.zeros(v.a_size, np.int64))
    for s, part in found.parts.items():
        np.maximum.at(top, part.keys // v.b_size, vector[found.first[s] : found.first[s] + len(part.keys)])


def _looked_up(ids: DataFrame, groups: list, best: dict, a_path, b_path) -> DataFrame:
    sc = ids.sparkSession.sparkContext
    top = sc.broadcast(best["a"])
    kind = ids.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])
    ddl = f"doc_id {kind.simpleString()}, {_OUT}"
    out = ids
    for i, (shared, vector) in enumerate(groups):
        final, first, counts = i == len(groups) - 1, i == 0, sc.broadcast(vector)

        def fn(batches: Iterator[pa.RecordBatch], shared=shared, counts=counts, final=final, first=first) -> Iterator[pa.RecordBatch]:
            v = load(a_path, b_path)
            for s in _rows(batches):
                x = Aligned(s, v)
                doc, pair = x.pairs(v)
                number, at = np.unique(pair, return_inverse=True)
                place = shared.value.find(number)
                n = np.where(place >= 0, counts.value[np.maximum(place, 0)] if len(counts.value) else 0, 0)[at]
                hits = (n > 0) & (n == top.value[pair // v.b_size])
                sums = [np.bincount(doc[hits], minlength=x.n), _sum(doc, n, x.n)]
                if not first:
                    sums = [a + s.column(c).to_numpy() for a, c in zip(sums, ("n_best", "count_sum"), strict=True)]
                if final:
                    made, digest = x.groups(v)
                    columns = [*(np.diff(f) for f in x.first), made, np.bincount(doc, minlength=x.n), *sums]
                    yield pa.RecordBatch.from_arrays([s.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(digest, pa.string())], schema=schema)
                else:
                    yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("a"), s.column("b"), *(pa.array(c, pa.int64()) for c in sums)], names=["doc_id", "a", "b", "n_best", "count_sum"])

        out = arrow(out, fn, ddl) if final else stored(arrow(out, fn, f"doc_id {kind.simpleString()}, a binary, b binary, n_best long, count_sum long"), "partly-looked-up")
    return out


def _sum(doc: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """Sums of integers by document, exact. ``doc`` rises."""
    ends = np.concatenate([[0], np.cumsum(n)])
    edge = np.searchsorted(doc, np.arange(rows + 1), "left")
    return ends[edge[1:]] - ends[edge[:-1]]


def op12_perfect_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
