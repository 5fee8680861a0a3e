"""Near-duplicates by SimHash over a hierarchical index in Gray order.

Fingerprints of a bucket are sorted by Gray rank, so neighbours share most bits. Sixteen in a row form a leaf, eight
nodes in a row a node above; a node keeps the bits that all below it share (a mask and a value). Two nodes whose
shared bits differ in more than ``MOST`` places can't hold a link, and neither can their children: whole groups are
pruned by the differences added up on the way down. Nodes whose members already hang together are pruned too, so a
dense group costs little more than its size.

Buckets: the 64 bits form five blocks; with four differing bits one block is equal, so a link meets in the bucket of
that block's value. A bucket with more than ``FULL`` fingerprints is dealt again by five blocks of its other bits, and
what is still full goes to pairs of parts, each pair to a task of its own. So tasks are bounded and no link is lost.
A task returns a spanning forest of its links (at most one row per fingerprint), never all pairs.

Equal fingerprints count once before the index: groups of exact copies collapse in the partial aggregation.

Edge cases: null and wordless texts have fingerprint zero and are linked like any other; rows without ``doc_id`` get a
fingerprint and the group's smallest id (null if the group has none); repeated rows give repeated rows; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow, batch_of, map_slices, raw_texts, stored
from pagemill.llm.components import stars

#: Differing bits of a link.
MOST = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a bucket that one task takes.
FULL = 32_768
LEAF, FAN = 16, 8

_SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; as a signed 64-bit number."""
    words = _SPACED.findall(text.lower())
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        h = np.array([digest(joined, SEED)], "<u8")
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size)
        starts = (ends - size)[:n].tolist()
        h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp``; ids of any type."""
    from pyspark.sql.pandas.types import to_arrow_type

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(schema, b.column("doc_id"), b.column("text_hash"), [fingerprint(t) for t in raw_texts(b)])

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("text_hash", pa.int64()), ("fp", pa.int64())])
    hashed = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_slices(hashed, fn, f"doc_id {kind.simpleString()}, text_hash long, fp long")


#: Tasks that a full bucket's codes are dealt to while they learn its size.
SALTS = 32
#: First bit and width of the blocks of the first deal, of 64 bits.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def _value(fp, start: int, width: int):
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _second(fp, first: int):
    """Blocks of the bits outside the first deal's block: the bits above it come round to below, then five parts."""
    start, width = BLOCKS[first]
    rest = 64 - width
    turned = fp if start + width == 64 else F.shiftleft(F.shiftrightunsigned(fp, start + width), start).bitwiseOR(_value(fp, 0, start) if start else F.lit(0).cast("long"))
    cuts = [rest * k // 5 for k in range(6)]
    return F.array(*[_key(5 + k, _value(turned, cuts[k], cuts[k + 1] - cuts[k])) for k in range(5)])


def _key(block: int, value):
    return (value * 16 + block).cast("long")


def buckets(codes: DataFrame, full: int = FULL) -> DataFrame:
    """``bucket, fp``: every pair within ``MOST`` bits meets in a bucket, and no bucket is much larger than ``full``."""
    first = codes.select("fp", F.explode(F.array(*[_key(k, _value(F.col("fp"), *BLOCKS[k])) for k in range(5)])).alias("key"))
    # At most 5 x 8192 rows, whatever the input.
    hot = first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > full).select("key", F.lit(True).alias("hot"))
    dealt = first.join(F.broadcast(hot), "key", "left")
    plain = dealt.where("hot is null").select(F.xxhash64("key").alias("bucket"), "fp")
    again = F.when(F.col("key") % 16 == 0, _second(F.col("fp"), 0))
    for k in range(1, 5):
        again = again.when(F.col("key") % 16 == k, _second(F.col("fp"), k))
    deep = dealt.where("hot").select("fp", "key", F.explode(again).alias("key2"))
    packed = deep.select("fp", F.xxhash64("key", "key2").alias("bucket"))
    still = packed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / full).cast("int").alias("parts")).where("parts > 1")
    # A bucket's codes go to the tasks of all salts; the few rows of its size go along. They are stored before: counted once.
    sized = stored(still, "full-buckets").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = packed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    split = salted.join(sized, ["bucket", "salt"], "left").drop("salt").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    paired = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.xxhash64("bucket", F.least(mine, "other"), F.greatest(mine, "other")).alias("bucket"), "fp"
    )
    return plain.unionByName(paired)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence: the running exclusive-or of its bits from the top."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class Index:
    """The hierarchical index over codes in bucket order; see the module's text."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), bucket))
        self.codes, bucket = codes[order], bucket[order]
        self.group = np.arange(len(codes))
        ones = self.codes
        starts = np.arange(0, len(codes), LEAF)
        level = {
            "all": np.bitwise_and.reduceat(ones, starts), "any": np.bitwise_or.reduceat(ones, starts),
            "low": np.minimum.reduceat(bucket, starts), "high": np.maximum.reduceat(bucket, starts),
        }
        self.levels = [level]
        while len(level["all"]) > 1:
            starts = np.arange(0, len(level["all"]), FAN)
            level = {
                "all": np.bitwise_and.reduceat(level["all"], starts), "any": np.bitwise_or.reduceat(level["any"], starts),
                "low": np.minimum.reduceat(level["low"], starts), "high": np.maximum.reduceat(level["high"], starts),
            }
            self.levels.append(level)

    def _open(self, k: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Pairs of nodes of a level that may hold a link: buckets meet, and shared bits differ in few places."""
        n = self.levels[k]
        meet = (n["low"][a] <= n["high"][b]) & (n["low"][b] <= n["high"][a])
        mask = ~(n["all"][a] ^ n["any"][a]) & ~(n["all"][b] ^ n["any"][b])
        return meet & (np.bitwise_count((n["all"][a] ^ n["all"][b]) & mask) <= most)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Take in links between positions; afterwards ``group`` is the smallest position of each group again."""
        while True:
            a, b = self.group[i], self.group[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            parent = np.arange(len(self.codes))
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.group = parent[self.group]

    def link(self, most: int = MOST, chunk: int = 16_384) -> None:
        """Find all groups of codes that hang together by links within buckets."""
        n = len(self.codes)
        near = np.flatnonzero(np.bitwise_count(self.codes[:-1] ^ self.codes[1:]) <= most)
        self._join(near, near + 1)
        zero = np.zeros(1, np.int64)
        waiting = [(len(self.levels) - 1, zero, zero)]
        while waiting:  # depth first, in bounded chunks
            k, a, b = waiting.pop()
            keep = self._open(k, a, b, most)
            a, b = a[keep], b[keep]
            if len(a) > chunk:
                waiting += [(k, a[at : at + chunk], b[at : at + chunk]) for at in range(0, len(a), chunk)][::-1]
            elif len(a) and k:
                size = len(self.levels[k - 1]["all"])
                left = (a[:, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel()
                right = (b[:, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
                fits = (left <= right) & (right < size)
                waiting.append((k - 1, left[fits], right[fits]))
            elif len(a):
                self._leaves(a, b, n, most)

    def _leaves(self, a: np.ndarray, b: np.ndarray, n: int, most: int) -> None:
        starts = np.arange(0, n, LEAF)
        for at in range(0, len(a), 2048):
            low, high = np.minimum.reduceat(self.group, starts), np.maximum.reduceat(self.group, starts)
            x, y = a[at : at + 2048], b[at : at + 2048]
            apart = np.maximum(high[x], high[y]) != np.minimum(low[x], low[y])
            x, y = x[apart], y[apart]
            if not len(x):
                continue
            i = np.minimum(x[:, None] * LEAF + np.arange(LEAF), n - 1)
            j = np.minimum(y[:, None] * LEAF + np.arange(LEAF), n - 1)
            close = np.bitwise_count(self.codes[i][:, :, None] ^ self.codes[j][:, None, :]) <= most
            p, r, s = np.nonzero(close)
            self._join(i[p, r], j[p, s])


def forest(bucketed: DataFrame) -> DataFrame:
    """``u, v``: for each group of a task's codes a star around the smallest one."""

    def fn(batches):
        held = [(b.column("bucket").to_numpy(), b.column("fp").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        bucket, codes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        index = Index(bucket, codes.view(np.uint64))
        index.link()
        found, least = index.codes.view(np.int64), np.full(len(codes), np.iinfo(np.int64).max)
        np.minimum.at(least, index.group, found)
        to = least[index.group]
        edges = np.unique(np.stack([found, to])[:, found != to], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["u", "v"])

    return arrow(bucketed.repartition("bucket"), fn, "u long, v long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, root`` for every row; ``root`` tells groups apart, also where they share a smallest id."""
    prints = stored(fingerprints(docs), "fingerprints")
    codes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-codes")
    star = stars(stored(forest(buckets(codes.select("fp"))), "fingerprint-links"))
    linked = star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
    members = stored(codes.join(linked, codes.fp == linked.node).select("fp", "least", "root"), "linked-codes")
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = members.select("fp", "root").join(smallest, "root").select("fp", "component_id", "root")
    named = codes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.join(stored(named, "fingerprint-classes"), "fp")


def one_per_class(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each group the row of smallest (id, fingerprint, hash of the text) stays.

    Rows without an id can't stand for a group and stay. An id that is repeated with texts of several groups may stand
    for each of them; of rows equal in id and text, one stays. Texts are shuffled once, by id and hash, at every size;
    copies of a row meet in their own task first.
    """
    key = ["__kept_id", "__kept_hash"]
    narrow = classes(docs.select("doc_id", "text")).where("doc_id is not null")
    first = narrow.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "text_hash")).alias("x"))
    keep = stored(first.select(F.col("x.doc_id").alias(key[0]), F.col("x.text_hash").alias(key[1])), "kept-rows")
    keyed = docs.where("doc_id is not null").withColumns({key[0]: F.col("doc_id"), key[1]: F.xxhash64("text")})
    kept = keyed.dropDuplicates(key).join(keep.hint("merge"), key, "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def op5_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
