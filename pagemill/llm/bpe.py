"""Byte-pair encoding by backtracking over longest token matches; decoding by an offset table.

Merges are exact and the time is linear in the text: an Aho-Corasick automaton over the vocabulary gives, at every
byte, the longest token that starts there; tokens are taken greedily and checked against their left neighbour in a
pair-compatibility table (a pair is compatible if the merges of the joined bytes give back just these two tokens);
an incompatible token falls back to its next shorter prefix token, then to dropping the token before it, and every
position is ruled out at most once.

Words of the pre-split pattern are merged on their own, so a worker keeps the ids of words it has seen (bounded).

Edge cases: a null text is empty (no ids); the strings of special tokens become their ids, as in the library;
any length of text is taken in bounded slices of rows; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import batch_of, map_slices, texts

#: Fixed value: the pre-split pattern of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps; beyond it the store starts anew.
KEPT_WORDS = 400_000
#: Pairs whose compatibility a worker keeps.
KEPT_PAIRS = 500_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the rest from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A vocabulary file of the tokenizers library (byte-level BPE) as automaton, pair table and offset table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        pieces: list[bytes] = [b""] * size
        for word, i in model["vocab"].items():
            pieces[i] = bytes(letters[c] for c in word) if word not in self.special else word.encode()
        for word, i in self.special.items():
            pieces[i] = word.encode()
        self.pieces = pieces
        self.whole = {b: i for i, b in enumerate(pieces) if b and i not in self.special.values()}
        self._merges(model["merges"], model["vocab"])
        self._automaton()
        self._offsets()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def _merges(self, merges, vocab) -> None:
        """Rank and result of each merge; for each token the merge that made it."""
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(merges):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            self.made.setdefault(c, (a, b))
        self.order = {c: self.rank[ab] for c, ab in self.made.items()}

    def _automaton(self) -> None:
        """The automaton over all tokens, and for each token the longest proper prefix that is a token."""
        self.aho = ahocorasick.Automaton()
        for b, i in self.whole.items():
            self.aho.add_word(b.decode("latin-1"), (i, len(b)))
        self.aho.make_automaton()
        self.shorter = [-1] * len(self.pieces)
        for b, i in self.whole.items():
            for k in range(len(b) - 1, 0, -1):
                if (j := self.whole.get(b[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.length = [len(b) for b in self.pieces]

    def _offsets(self) -> None:
        sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        self.size = sizes
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)

    def pair(self, a: int, b: int) -> bool:
        """Whether a and b stay side by side: no merge across the border comes before the merges that built them."""
        key = a << 32 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= KEPT_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._pair(a, b)
        return known

    def _pair(self, a: int, b: int) -> bool:
        """Undo the merges of both sides, latest first, and look for an earlier merge across the border."""
        limit = 1 << 60
        while True:
            if self.rank.get((a, b), 1 << 60) < limit:
                return False
            ra, rb = self.order.get(a, -1), self.order.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit = ra
                a = self.made[a][1]
                # The same merge can't take place across the border before it does on the left.
                if self.rank.get((a, b), 1 << 60) < limit:
                    return False
            else:
                limit = rb + 1
                b = self.made[b][0]
                if self.rank.get((a, b), 1 << 60) < limit:
                    return False
                limit = rb

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        if (one := self.whole.get(word)) is not None and (one in self.made or len(word) == 1):
            return [one]
        n = len(word)
        longest = [-1] * (n + 1)
        width = [0] * n
        for end, (i, size) in self.aho.iter(word.decode("latin-1")):
            at = end - size + 1
            if size > width[at]:
                width[at], longest[at] = size, i
        length, shorter, pair = self.length, self.shorter, self.pair
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while True:
                end = at + length[token]
                if alive[end] and (not out or pair(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at]
                    break
                token = shorter[token]
                if token < 0:
                    alive[at] = 0
                    token = out.pop()
                    at -= length[token]
        return out

    def _plain(self, text: str) -> list[str]:
        return self.split.findall(text)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        parts: list[bytes] = []
        last = 0
        for m in self.cut.finditer(text) if self.cut and "<" in text else ():
            parts += self._ids(text[last : m.start()])
            parts.append(np.uint32(self.special[m.group()]).tobytes())
            last = m.end()
        parts += self._ids(text[last:] if last else text)
        return b"".join(parts)

    def _ids(self, text: str) -> list[bytes]:
        found, known = self._plain(text), self.words
        for w in [w for w in set(found) if w not in known]:
            known[w] = np.array(self.merge(w.encode()), "<u4").tobytes()
        return [known[w] for w in found]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of all ids, gathered from the offset table in one step."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        where = np.repeat(self.start[ids] - (ends - size), size)
        where += np.arange(len(where))
        return self.bytes[where].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """Once per worker process."""
    return Bpe(path)


def vocabulary(name: str) -> str:
    """A file of the installed vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit). ``path``: a vocabulary file every executor has."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path or vocabulary("byte_bpe_50k.json"))
        ids = [bpe.encode(t) for t in texts(b)]
        return batch_of(out, b.column("doc_id"), [len(x) // 4 for x in ids], ids)

    out = pa.schema([("doc_id", _arrow(docs, "doc_id")), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return map_slices(docs.select("doc_id", docs[text].alias("text")), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path or vocabulary("byte_bpe_50k.json"))
        ids = [np.frombuffer(x or b"", "<u4") for x in b.column("ids").to_pylist()]
        return batch_of(out, b.column("doc_id"), [bpe.decode(x) for x in ids])

    out = pa.schema([("doc_id", _arrow(tokens, "doc_id")), ("text", pa.string())])
    return map_slices(tokens.select("doc_id", "ids"), fn, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string", "ids")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def round_trips(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``): encoded, and decoded again from the ids, in one task."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path or vocabulary("byte_bpe_50k.json"))
        ids = [bpe.encode(t) for t in texts(b)]
        back = [bpe.decode(np.frombuffer(x, "<u4")).encode() for x in ids]
        return batch_of(out, b.column("doc_id"), [len(x) // 4 for x in ids], [_sha(x) for x in ids], [_sha(x) for x in back], *([ids] if keep_ids else []))

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("doc_id", _arrow(docs, "doc_id")), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out = pa.schema(fields + [("ids", pa.binary())] * keep_ids)
    ddl = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return map_slices(docs.select("doc_id", "text"), fn, ddl)


_sha: Callable[[bytes], str] = lambda b: hashlib.sha256(b).hexdigest()


def op9_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
