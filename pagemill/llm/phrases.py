"""Collocations by stripes: each prefix keys a counter of the words that follow it.

A stripe belongs to a language and a prefix of up to four words. Its entries count the prefix with each next word;
entry 0 counts the prefix alone. Tasks fill stripes from their texts and hand them on in pieces by next word, so that
the stripe of a frequent prefix is spread over many tasks; pieces travel in buckets, many to a row, and are merged
elementwise. One structure gives

* extensions: an entry is the frequency of a phrase one word longer,
* prefix totals: entry 0 is the frequency of the prefix, a part of every cut,
* subsumption maxima: a stripe's largest entry bounds its prefix from the right, and each entry, handed to the words
  behind its first one, from the left. A phrase can't be more frequent than its parts, so if any longer candidate
  subsumes one, then a candidate one word longer does.

Texts are read once per prefix length. A phrase reaches the threshold only if both its parts without one end do, so
later passes count windows whose parts passed, which a bitmap of the passed ones' hashes tells (at most ``MOST_BITS``
bits). A full bitmap lets more windows through, counts stay exact. So shuffles hold little beyond what may still count.

Words are keyed by 64-bit hashes over their bytes and language, phrases by hashes over their words' keys. Word keys are
compared with the words of the whole corpus and phrase keys with the passed phrases; if two share one, all is counted
anew with other hashes.

Edge cases: a null text is empty, a null language is ``und``; pieces are cut at ASCII signs, so nothing else is a
border; texts of any length are taken whole, one at a time if longer than a slice; repeated rows count as often as they
occur; ties rank by frequency, then phrase; an empty table, or one without frequent phrases, gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import arrow, raw_texts, slices, stored, table

#: Words of the longest phrase, occurrences of a candidate, and phrases of a language that are returned.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A candidate goes if a longer one that holds it has at least this share of its occurrences, in percent.
SUBSUMED = 100
#: Pieces of a stripe, and buckets of pieces: a row that a task hands on is a bucket.
PIECES, BUCKETS = 64, 4096
#: Windows of a partition of buckets, at most, if no task merged any.
WINDOWS = 1 << 21
#: Bits of the bitmap for a passed phrase, at least and at most; bits of a chunk that one task makes.
KEY_BITS, LEAST_BITS, MOST_BITS, CHUNK_BITS = 32, 1 << 20, 1 << 29, 1 << 23
#: New entries that a task merges, merged ones that it merges anew (and hands on if half are left), and entries of a batch.
MERGE, HOLD, BATCH = 1 << 19, 1 << 21, 1 << 18
#: Bytes of words that a task holds before it merges them, and before it hands them on.
MERGE_BYTES, HOLD_BYTES = 16 << 20, 48 << 20
#: Bytes of a word that are hashed by eights; longer words one by one.
SHORT = 32

_STEP = 0x9E3779B97F4A7C15 | 1  # odd
_WORD, _BORDER = np.ones(256, bool), np.zeros(256, bool)
_BORDER[list(b".,;:!?\n\v\f\r")] = True
_WORD[list(b" \t.,;:!?\n\v\f\r")] = False
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit number over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Keys:
    """Hashes of words and phrases for one seed."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.factor, self.length = (rng.integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
        self.secret = rng.bytes(16)

    def words(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of each run of bytes; never 0."""
        size = stop - start
        padded = np.zeros(len(raw) + 8, np.uint8)
        padded[: len(raw)] = raw
        eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        out = mix((eight[start] & _BYTES[np.minimum(size, 8)]) * np.uint64(self.factor) + size.astype(np.uint64) * np.uint64(self.length))
        for done in range(8, SHORT, 8):
            rest = np.flatnonzero((size > done) & (size <= SHORT))
            if not len(rest):
                continue
            part = eight[start[rest] + done] & _BYTES[np.minimum(size[rest] - done, 8)]
            out[rest] = mix(out[rest] * np.uint64(_STEP) + part * np.uint64(self.factor))
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = int.from_bytes(blake2b(raw[start[i] : stop[i]], digest_size=8, key=self.secret).digest(), "little")
        return out | np.uint64(1)

    @staticmethod
    def with_lang(words: np.ndarray, lang: np.ndarray) -> np.ndarray:
        # Not symmetric: a word may be spelled like a language's name.
        return mix(lang * np.uint64(_STEP) + words) | np.uint64(1)

    @staticmethod
    def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The key of a phrase from its prefix's key and its last word's; never 0."""
        return mix(prefix * np.uint64(_STEP) + word) | np.uint64(1)

    def lang(self, name: str) -> np.uint64:
        raw = np.frombuffer(name.encode() or b"\0", np.uint8)
        return self.words(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0]


class Cut:
    """A slice's words: runs of bytes, whether a border follows each, and numbers and names of their languages."""

    def __init__(self, batch: pa.RecordBatch):
        docs = [t.lower() for t in raw_texts(batch)]
        self.raw = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
        self.inside = _WORD[self.raw]
        edges = np.flatnonzero(self.inside[1:] != self.inside[:-1]) + 1
        if self.inside[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.stop = edges[::2], edges[1::2]
        self.border = _BORDER[self.raw[self.stop]]
        wide = np.flatnonzero(self.start[1:] - self.stop[:-1] > 1)  # more than one sign up to the next word
        if len(wide):
            signs = np.flatnonzero(_BORDER[self.raw])  # the last byte is one
            self.border[wide] = signs[np.searchsorted(signs, self.stop[wide])] < self.start[wide + 1]
        self.border[-1:] = True
        names, of_doc = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
        self.names = [str(n) for n in names]
        ends = np.cumsum([len(d) + 1 for d in docs])
        self.lang = np.repeat(of_doc, np.diff(np.searchsorted(self.start, ends), prepend=0))

    def keys(self, keys: Keys) -> np.ndarray:
        """Keys of the words with their language."""
        seeds = np.array([keys.lang(n) for n in self.names], np.uint64)
        return keys.with_lang(keys.words(self.raw, self.start, self.stop), seeds[self.lang])

    def counted(self, keys: Keys) -> pa.Table:
        """``lang, key, word, n``: the different words, told apart by their bytes; and each language's total under no word."""
        ends = np.cumsum(self.stop - self.start, dtype=np.int32)
        data = [None, pa.py_buffer(np.concatenate([np.zeros(1, np.int32), ends])), pa.py_buffer(self.raw[self.inside])]
        found = pa.Array.from_buffers(pa.binary(), len(ends), data).dictionary_encode()
        different, of = found.dictionary, found.indices.to_numpy()
        both, n = np.unique(self.lang * np.int64(len(different)) + of, return_counts=True)
        lang, word = both // max(len(different), 1), both % max(len(different), 1)
        _, places, data = different.buffers()
        place = np.frombuffer(places, np.int32)[: len(different) + 1].astype(np.int64) if len(different) else np.zeros(1, np.int64)
        plain = keys.words(np.frombuffer(data, np.uint8) if len(different) else self.raw, place[:-1], place[1:])
        seeds = np.array([keys.lang(x) for x in self.names], np.uint64)
        names, every = pa.array(self.names, pa.string()), np.arange(len(self.names))
        total = np.bincount(self.lang, minlength=len(self.names))
        return pa.table({
            "lang": pa.concat_arrays([names.take(pa.array(every)), names.take(pa.array(lang))]),
            "key": np.concatenate([np.zeros(len(every), np.int64), keys.with_lang(plain[word], seeds[lang]).view(np.int64)]),
            "word": pa.concat_arrays([pa.nulls(len(every), pa.binary()), different.take(pa.array(word))]),
            "n": np.concatenate([total, n]),
        })


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def words(docs: DataFrame, seed: int) -> DataFrame:
    """The stripes of the empty prefix: ``lang, key, word, n``. Word null (key 0) is the language's total."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by(["lang", "key", "word"], use_threads=False).aggregate([("n", "sum")])
        return found.rename_columns({"n_sum": "n"}).select(["lang", "key", "word", "n"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, new = Keys(seed), [], 0
        for b in slices(batches):
            held.append(Cut(b).counted(keys))
            new += held[-1].nbytes
            if new > MERGE_BYTES:
                held, new = [merged(held)], 0
                pa.default_memory_pool().release_unused()
                if held[0].nbytes > HOLD_BYTES:
                    yield from held.pop().to_batches(max_chunksize=BATCH)
        if held:
            yield from merged(held).to_batches(max_chunksize=BATCH)

    counted = arrow(_texts(docs), fn, "lang string, key long, word binary, n long").repartition("lang", "key")
    return counted.groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))


class Held:
    """Stripe entries of a task: phrase key, prefix key, next word's key and count.

    New entries are merged among themselves, and what comes of that with the rest only when all is too large to hold, so
    a long task doesn't sort what it holds again and again.
    """

    def __init__(self):
        self.new: list[tuple] = []
        self.parts: list[tuple] = []
        self.fresh = self.size = 0

    def add(self, phrase: np.ndarray, prefix: np.ndarray, follow: np.ndarray) -> None:
        """Windows with a next word, as they come."""
        self._add(phrase, prefix, follow, np.ones(len(phrase), np.int32))

    def add_totals(self, prefix: np.ndarray) -> None:
        prefix, n = np.unique(prefix, return_counts=True)
        self._add(prefix, prefix, np.zeros(len(prefix), np.uint64), n)

    def _add(self, *part: np.ndarray) -> None:
        self.new.append(part)
        self.fresh += len(part[0])
        if self.fresh > MERGE:
            self._settle()
            if self.size > HOLD:
                self.merge()

    def _settle(self) -> None:
        if self.new:
            self.parts.append(self._merged(self.new))
            self.fresh = 0
            self.size += len(self.parts[-1][0])

    def merge(self) -> None:
        self._settle()
        if len(self.parts) > 1:
            self.parts = [self._merged(self.parts)]
            self.size = len(self.parts[0][0])

    @staticmethod
    def _merged(parts: list[tuple]) -> tuple:
        """Takes the parts out of their list; one column at a time is held twice."""
        columns = [list(x) for x in zip(*parts, strict=True)]
        parts.clear()

        def column() -> np.ndarray:
            x = columns.pop(0)
            return np.concatenate(x)

        phrase = column()
        order = np.argsort(phrase)
        phrase = phrase[order]
        new = _steps(phrase)
        prefix = column()[order]
        # A prefix and a phrase's key leave one next word, but for a bit.
        if (_steps(prefix) & ~new).any():  # phrases that share a key stay apart
            follow = np.concatenate(columns[0])[order]
            again = np.lexsort((follow, prefix))
            order, phrase, prefix = order[again], phrase[again], prefix[again]
            new = _steps(prefix) | _steps(follow[again])
        first = np.flatnonzero(new)
        phrase, prefix = phrase[first], prefix[first]
        follow = column()[order[first]]
        return phrase, prefix, follow, np.add.reduceat(column()[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)

    def full(self) -> bool:
        """Whether merged entries are so many that more of them would soon have to be merged again."""
        return self.size > HOLD // 2 and len(self.parts) == 1

    def stripes(self) -> Iterator[pa.RecordBatch]:
        """``bucket, prefix, next, n``: one row for each bucket, with the entries of its pieces of stripes as lists."""
        self.merge()
        phrase, prefix, follow, n = self.parts.pop()
        self.size = 0
        del phrase
        bucket = mix(prefix + (follow >> np.uint64(8)) % np.uint64(PIECES) * np.uint64(_STEP)) % np.uint64(BUCKETS)
        order = np.argsort(bucket << np.uint64(52) | prefix >> np.uint64(12))  # a stripe's entries side by side
        bucket = bucket.astype(np.int32)[order]
        starts = np.flatnonzero(_steps(bucket))
        batch = starts // BATCH
        for i in np.unique(batch):
            rows = np.flatnonzero(batch == i)
            a, z = starts[rows[0]], starts[rows[-1] + 1] if rows[-1] + 1 < len(starts) else len(bucket)
            offsets = pa.array(np.append(starts[rows], z) - a, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order[a:z]].view(np.int64))) for x in (prefix, follow, n)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts[rows]]), *lists], names=["bucket", "prefix", "next", "n"])


def _steps(x: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it; the first one does."""
    return np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])


def _hit(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key >> np.uint64(65 - len(bits).bit_length() - 3)  # as many top bits as the bitmap has places
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(passed: DataFrame, entries: int, most: int = MOST_BITS) -> np.ndarray:
    """Bits at the hashes ``key``; made in chunks by tasks. At most ``most`` bits reach the driver."""
    width = min(max(LEAST_BITS, 1 << (entries * KEY_BITS).bit_length()), most).bit_length() - 1
    chunk = min(width, CHUNK_BITS.bit_length() - 1)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        for b in batches:
            of, key = b.column("chunk").to_numpy(), b.column("key").to_numpy().view(np.uint64)
            for c in np.unique(of):
                if c != now:
                    if bits is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits.tobytes()])], names=["chunk", "bits"])
                    now, bits = int(c), np.zeros((1 << chunk) // 8, np.uint8)
                at = (key[of == c] >> np.uint64(64 - width)) & np.uint64((1 << chunk) - 1)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if bits is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits.tobytes()])], names=["chunk", "bits"])

    top = F.shiftrightunsigned("key", 64 - width + chunk) if width > chunk else F.lit(0).cast("long")
    dealt = passed.select("key", top.alias("chunk")).repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros((1 << width) // 8, np.uint8)
    for r in arrow(dealt, fn, "chunk long, bits binary").toLocalIterator():
        out[r["chunk"] * ((1 << chunk) // 8) :][: (1 << chunk) // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def stripes(docs: DataFrame, size: int, passed: DataFrame, entries: int, total: int, seed: int, least: int = LEAST, most: int = MOST_BITS) -> DataFrame:
    """``prefix, next, n``: merged entries of the prefixes of ``size`` words, those of at least ``least``. ``next`` 0: the total.

    ``total``: words of the corpus, by which the partitions of the merge are counted.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(bitmap(passed, entries, most))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, bits = Keys(seed), Held(), shared.value
        for b in slices(batches):
            cut = Cut(b)
            key, border = cut.keys(keys), cut.border
            phrase, inside = key, np.ones(len(key), bool)
            for k in range(1, size):  # windows of k + 1 words that no border cuts
                inside = inside[:-1] & ~border[k - 1 : len(border) - 1]
                phrase = keys.longer(phrase[:-1], key[k:])
            at = np.flatnonzero(inside & _hit(bits, phrase))
            if not len(at):
                continue
            known = np.zeros(len(key) + 1, bool)
            known[at] = True
            ends = at + size - 1  # the prefix's last word
            goes_on = known[at + 1] & ~border[ends]
            prefix, follow = phrase[at[goes_on]], key[ends[goes_on] + 1]
            held.add_totals(phrase[at])
            held.add(keys.longer(prefix, follow), prefix, follow)
            if held.full():
                yield from held.stripes()
        if held.parts or held.new:
            yield from held.stripes()

    buckets = arrow(_texts(docs), fn, "bucket int, prefix array<long>, next array<long>, n array<long>")
    dealt = buckets.repartition(max(context.defaultParallelism, -(-total // WINDOWS)), "bucket")
    entry = dealt.select("bucket", "next", "n", F.posexplode("prefix").alias("i", "of"))
    entry = entry.select("bucket", F.col("of").alias("prefix"), F.get("next", "i").alias("next"), F.get("n", "i").alias("n"))
    merged = entry.groupBy("bucket", "prefix", "next").agg(F.sum("n").alias("n"))
    return merged.where(F.col("n") >= least).select("prefix", "next", "n")


def _with_keys(found: DataFrame) -> DataFrame:
    """``found`` (``prefix, next`` and others) with the longer phrases' keys."""

    def fn(batches):
        for b in batches:
            key = Keys.longer(b.column("prefix").to_numpy().view(np.uint64), b.column("next").to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", *b.schema.names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return arrow(found, fn, f"key long, {fields}")


def _shared(df: DataFrame, *keys: str) -> bool:
    return bool(df.groupBy(*keys).count().where("count > 1").limit(1).count())


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most_bits: int = MOST_BITS, seeds: range = range(8)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lang, n``; totals ``lang, phrase, f`` of the prefixes; extensions ``lang, phrase, words, a, rest, prefix``.

    ``rest`` is the phrase without its first word, ``prefix`` the one without its last.
    """
    for seed in seeds:
        vocabulary = stored(words(docs, seed), "words")
        if _shared(vocabulary, "lang", "key"):
            continue
        n = vocabulary.where("word is null").select("lang", "n")
        total = n.agg(F.sum("n")).first()[0] or 0
        some = vocabulary.where(F.col("word").isNotNull() & (F.col("n") >= least))
        first = stored(some.select("lang", "key", F.col("word").cast("string").alias("word")), "frequent-words")
        passed = first.select("lang", "key", F.col("word").alias("phrase"), F.array("word").alias("words"))
        totals, longer, clash = [], [], False
        for size in range(1, longest):
            entries = passed.count()
            if not entries:
                break
            found = stored(stripes(docs, size, passed.select("key"), entries, total, seed, least, most_bits), f"stripes-{size}")
            totals.append(found.where("next = 0").join(passed, F.col("prefix") == F.col("key")).select("lang", "phrase", F.col("n").alias("f")))
            named = found.where("next <> 0").join(passed.withColumnRenamed("key", "of"), F.col("prefix") == F.col("of"))
            named = named.join(first.select(F.col("key").alias("last"), "word"), F.col("next") == F.col("last"))
            named = named.select("lang", "prefix", "next", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.concat("words", F.array("word")).alias("words"), F.col("n").alias("a"))
            longer.append(stored(_with_keys(named), f"phrases-{size + 1}"))
            passed = longer[-1].select("lang", "key", "phrase", "words")
            clash = clash or _shared(passed, "key")
        if clash:
            continue
        none = docs.sparkSession.createDataFrame([], "lang string, phrase string, words array<string>, a long, f long")
        every, tops = none.select("lang", "phrase", "words", "a"), none.select("lang", "phrase", "f")
        for x in longer:
            every = every.unionByName(x.select("lang", "phrase", "words", "a"))
        for x in totals:
            tops = tops.unionByName(x)
        return n, tops, every
    raise ValueError("keys clash under every seed")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED, most_bits: int = MOST_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's phrases of two words and more, best first."""
    n, totals, every = frequent(docs, longest, least, most_bits)
    part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    size = F.size("words")

    # Largest extensions: the phrase's own stripe to the right, and to the left the stripes that end in it.
    ends = F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))
    bound = every.where(size > 2).select("lang", F.explode(ends).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = every.join(bound, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < subsumed * F.col("a"), F.lit(True)))

    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, size).alias("right"))
    with_left = cuts.join(totals.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    with_both = with_left.join(totals.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # Products pass 64 bits; decimals of 38 digits keep them exact.
    exact = "(1000 * cast(a AS decimal(38,0)) * cast(n AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0)))"
    scored = with_both.join(n, "lang").withColumn("score", F.expr(exact))
    least_cut = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = least_cut.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").cast("long").alias("score"))
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(w) >= k) GROUP BY lang, k, phrase),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= {LEAST}),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
  SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest(range(2, {LONGEST})) AS m) WHERE m < k) GROUP BY lang, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * longer < {SUBSUMED} * a, true)),
cuts AS (SELECT lang, phrase, a, s, array_to_string(w[1:s], ' ') AS x, array_to_string(w[s + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS s FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, s, gx.f AS l, gy.f AS r, n, (1000::HUGEINT * a * n) // (gx.f::HUGEINT * gy.f) AS score
  FROM cuts JOIN g gx ON gx.lang = cuts.lang AND gx.phrase = x JOIN g gy ON gy.lang = cuts.lang AND gy.phrase = y JOIN n ON n.lang = cuts.lang),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, s) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM least_cut QUALIFY rank <= {TOP}
"""
