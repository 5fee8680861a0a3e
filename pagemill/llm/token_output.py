"""Token ids on disk: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

The most frequent id of the corpus gets rank 0, and so on; a rank takes one to four data bytes, and a control byte
holds the lengths of four ranks, two bits each. Four at a time keeps control and data apart, so that decoding is a
numpy table lookup: control byte to lengths, lengths to offsets, offsets to values.

Texts are dealt to files by ranges of ``doc_id``, encoded once and kept as a table of ids while the counts of all
documents are summed; then each file is written again as blocks of coded ranks. A file is a Parquet file whose rows
are blocks, in ascending ``doc_id`` order by their keys ``file, first``, with the documents' ids and lengths. So any store that Spark writes to can hold it.
The table of ranks lies beside the blocks, so a folder is all that a reader needs, in any session.

Edge cases: a null text is empty and holds only the end id; ties of ``doc_id`` are ordered by the text's hash, then
its ids; null ids come first; copies of one row may be split among files; an empty table gives no files; one text may exceed a block, which then is its own.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import SPACED, arrow, batch_of, slices, stored, texts
from pagemill.session import shared_dir

#: Chunks between white space, and their pieces, whose ids a worker keeps; beyond it a store starts anew.
KEPT_CHUNKS, KEPT_PIECES = 800_000, 500_000
#: Ids in a block of a file; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: The id that closes each document.
END_ID = 1

# Chunks between white space whose pieces the vocabulary's pattern splits in any context: Latin letters that no
# normalisation changes but for case, digits, and ASCII signs without the apostrophe (contractions).
_SAFE = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]+")
_PIECES = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


# The split pattern that the store of chunks goes by.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_at_space(file: dict) -> bool:
    """Whether a vocabulary file lower-cases, splits and ends words as the store assumes; others go through the library whole."""
    steps = [n.get("type") for n in (file.get("normalizer") or {}).get("normalizers", [])]
    cuts = [str(p.get("pattern", {}).get("Regex")) for p in (file.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split"]
    plain = all("<|" in t["content"] and not re.search(r"\s", t["content"]) for t in file.get("added_tokens", []))
    return plain and steps == ["NFC", "Replace", "Lowercase"] and cuts == [_SPLIT] and file["model"].get("end_of_word_suffix") == "</w>"


class Words:
    """The tokenizers library behind a bounded store of chunks between white space.

    White space never takes part in a token of this vocabulary and every chunk is encoded on its own, so ids of a
    text are the ids of its chunks in a row. Safe chunks go through the library in joined calls, told apart by their
    words' ends; all others one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.size = self.lib.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        for word, i in self.lib.get_vocab().items():
            self.ends[i] = word.endswith("</w>")
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.by_word = _splits_at_space(json.loads(self.lib.to_str()))

    def _library(self, items: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(items, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        safe, other = {}, []
        for c in chunks:
            if _SAFE.fullmatch(c) and "<|" not in c:
                safe[c] = _PIECES.findall(c.lower())
            else:
                other.append(c)
        for c, ids in zip(other, self._library(other), strict=True):
            self.chunks[c] = np.array(ids, "<u4").tobytes()
        known = self.pieces
        new = list({p for ps in safe.values() for p in ps if p not in known})
        for i in range(0, len(new), 200):
            part = new[i : i + 200]
            ids = np.array(self._library([" ".join(part)])[0], "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the vocabulary doesn't end words as expected")
            raw, start = ids.tobytes(), 0
            for p, stop in zip(part, (stops * 4).tolist(), strict=True):
                known[p] = raw[start:stop]
                start = stop
        for c, ps in safe.items():
            self.chunks[c] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])

    def encode(self, items: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return [np.array(ids, "<u4").tobytes() for ids in self._library(items)]
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks.clear()
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        # str.split() also parts at four separators that the vocabulary keeps; elsewhere it parts at white space only.
        words = [SPACED.findall(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in items]
        known = self.chunks
        new: set[str] = set()
        for w in words:
            new |= set(w).difference(known)
        self._learn(list(new))
        return [b"".join(map(known.__getitem__, w)) for w in words]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Words:
    """Once per worker process."""
    return Words(path)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Lengths of the four ranks of each control byte, and their sum.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks; the last group is filled up by zeros that the reader drops."""
    n = -len(ranks) % 4
    r = np.concatenate([ranks.astype("<u4"), np.zeros(n, "<u4")])
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = (size - 1).reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of :func:`pack`."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    raw = np.zeros((len(size), 4), np.uint8)
    raw[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return raw.reshape(-1).view("<u4")[:n]


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """``file, seq, doc_id, n_ids, ids``: dealt to files by ranges of ``doc_id``, numbered in ascending order in each."""

    def fn(batches):
        lib = load(path or _vocabulary())
        end, seq = np.array([end_id], "<u4").tobytes(), 0
        for b in slices(batches):
            ids = [x + end for x in lib.encode(texts(b))]
            narrow = [np.frombuffer(x, "<u4").astype(_width(lib.size)).tobytes() for x in ids]
            yield batch_of(schema, b.column("file"), pa.array(np.arange(seq, seq + len(ids))), b.column("doc_id"), [len(x) // 4 for x in ids], narrow)
            seq += len(ids)

    schema = pa.schema([("file", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])
    # Copies of one row are told apart by a hash of their place in the table, so that many of them are several files' work.
    # ``docs`` has to give its rows in the same places when a task runs again, as a stored table does.
    place = F.xxhash64(F.monotonically_increasing_id())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), place.alias("copy"))
    ranged = keyed.repartitionByRange(files, "doc_id", "tie", "copy") if files else keyed.repartitionByRange("doc_id", "tie", "copy")
    ordered = ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("file"))
    return arrow(ordered, fn, "file int, seq long, doc_id long, n_ids long, ids binary")


def _width(lib_size: int) -> str:
    return "<u2" if lib_size <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``id, n`` over all documents: summed in each task first, so at most one row per id and task is shuffled."""

    def fn(batches):
        lib = load(path or _vocabulary())
        sums = np.zeros(lib.size, np.int64)
        for b in batches:
            sums += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), _width(lib.size)), minlength=lib.size)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used], pa.int64())], names=["id", "n"])

    return arrow(tokens.select("ids"), fn, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def ranking(counts: DataFrame, size: int) -> np.ndarray:
    """Ids by falling frequency, ties by id; ids that never occur come last. Bounded by the vocabulary."""
    n = np.zeros(size, np.int64)
    for r in counts.toLocalIterator():
        n[r["id"]] = r["n"]
    return np.lexsort((np.arange(size), -n)).astype("<u4")


def coded(tokens: DataFrame, by_rank: np.ndarray, block_ids: int = BLOCK_IDS, path: str | None = None) -> DataFrame:
    """Blocks of coded ranks: ``file, first, n_ids, doc_ids, lengths, control, data``.

    A block holds documents that stand in a row in one file and is known by the number of its first one. However the
    scan splits or packs the files of the token table, it reads rows of a split in order, so nothing is shuffled.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(by_rank)  # one entry per id of the vocabulary

    def fn(batches):
        width = np.dtype(_width(load(path or _vocabulary()).size))
        rank = np.empty(len(shared.value), "<u4")
        rank[shared.value] = np.arange(len(rank))
        held: list[tuple] = []
        total = 0

        def done():
            control, data = pack(rank[np.frombuffer(b"".join([x[3] for x in held]), width)])
            sizes = [len(x[3]) // width.itemsize for x in held]
            return batch_of(schema, [held[0][0]], [held[0][1]], [sum(sizes)], [[x[2] for x in held]], [sizes], [control], [data])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("file", "seq", "doc_id", "ids")), strict=True):
                n = len(row[3]) // width.itemsize
                if held and (row[0] != held[0][0] or row[1] != held[-1][1] + 1 or total + n > block_ids):
                    yield done()
                    held, total = [], 0
                held.append(row)
                total += n
        if held:
            yield done()

    schema = pa.schema([("file", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
    blocks = arrow(tokens.select("file", "seq", "doc_id", "ids"), fn, "file int, first long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary")
    return blocks.sortWithinPartitions("file", "first")


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write ``blocks`` and ``ranks`` (``rank, id``) below a folder."""
    tokens = stored(encoded(docs, path, end_id), "token-ids")
    counts = id_counts(tokens, path)
    by_rank = ranking(counts, load(path or _vocabulary()).size)
    spark = docs.sparkSession
    ranks = spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(by_rank)), pa.int32()), "id": pa.array(by_rank, pa.int64())}))
    ranks.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")
    coded(tokens, by_rank, path=path).write.mode("overwrite").parquet(f"{folder}/blocks")


def rank_table(spark: SparkSession, folder: str) -> np.ndarray:
    """The ids in order of their ranks, from a written folder. Bounded by the vocabulary."""
    rows = spark.read.parquet(f"{folder}/ranks").toArrow()
    out = np.empty(rows.num_rows, "<u4")
    out[rows.column("rank").to_numpy()] = rows.column("id").to_numpy()
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a folder that ``write`` made: decoded from the blocks by table lookup.

    ``start`` adds what all blocks before hold: a running sum over one narrow row per block, by file first.
    """
    blocks, by_rank = spark.read.parquet(f"{folder}/blocks"), rank_table(spark, folder)
    shared = blocks.sparkSession.sparkContext.broadcast(by_rank)
    per_file = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = per_file.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    in_file = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "first", F.coalesce(F.sum("n_ids").over(in_file), F.lit(0)).alias("in_file")).join(before, "file")
    starts = starts.select("file", "first", (F.col("file_start") + F.col("in_file")).alias("ids_before"))

    def fn(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids = shared.value[unpack(r["control"], r["data"], r["n_ids"])]
                n = np.array(r["lengths"], np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), r["lengths"], strict=True)]
                yield batch_of(schema, [r["file"]] * len(n), [r["first"]] * len(n), r["doc_ids"], pa.array(ends - n), r["lengths"], crc)

    schema = pa.schema([("file", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("in_block", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    rows = arrow(blocks, fn, "file int, first long, doc_id long, in_block long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["file", "first"]).select("doc_id", (F.col("ids_before") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")


def op8_ranked_vbyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read(spark, folder)
