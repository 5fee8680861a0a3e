"""Personal data: four exact finders, and further spans by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns. Further candidates are runs of letters and digits that hold
digits, and values that a field name introduces. Labelers vote on each candidate: patterns, a gazetteer of field names,
and the context around it; each says yes, no or nothing. Expectation-maximisation over the vote patterns of *all*
documents estimates how reliable each labeler is and how likely each pattern means personal data; these likelihoods
train the final span classifier, a logistic regression over features of the span. What is gathered from the corpus is a
table of counts by vote pattern and feature code, both from small fixed sets.

Edge cases: a null text is empty and has no spans; spans count code points; a candidate that touches a base span is
dropped, except a field's value of which base spans cover less than half; a field's value is taken whole, however long, to its closing quote or to white space; without candidates no span is added; all finders are linear in the text; repeated rows each get their result;
columns of any name are kept.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import add_columns, arrow, batch_of, map_slices, stored, texts

#: Kinds in the order of equal starts; the last two are the classifier's.
KINDS = ("email", "ip", "card", "phone", "secret", "number")

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and (not p or int(p) <= 255)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += (d * 2 - 9 if d > 4 else d * 2) if k % 2 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_part, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out)


_DIGIT = re.compile("[0-9]")
_RUN = re.compile(r"[0-9A-Za-z]*[0-9][0-9A-Za-z]*(?:-[0-9A-Za-z]+)*")
# A field's value: to its closing quote, or else to the next white space, without the signs that end a sentence.
_FIELD = re.compile(r"""[:=]\x20*(?:"(?P<a>[^"\n]{6,}+)"|'(?P<b>[^'\n]{6,}+)'|["']?(?P<c>[^\s"']{6,}+))""")
_WORD = re.compile(r"[A-Za-z]+")
_HEX = re.compile(r"[0-9a-fA-F]+")
_GROUPS = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}|[0-9]{4}(?:-[0-9]{4}){2,3}")

#: Field names before a value. A longer list gives the labeler more to go by; it decides nothing alone.
SECRET_FIELDS = frozenset("token secret key apikey password passwd pwd passphrase credential bearer auth".split())
ID_FIELDS = frozenset("ssn iban passport account acct license licence tax dob born birth patient member customer card".split())
CONTACT_FIELDS = frozenset("phone tel mobile fax email address street zip".split())

#: Distance of the context that labelers read, in code points.
NEAR = 24


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Digit-bearing runs of six or more that touch no base span, and whole values of fields that aren't mostly base spans."""
    if not (_DIGIT.search(text) or ":" in text or "=" in text):
        return []
    values = set(_values(text))
    out: list[tuple[int, int]] = []
    k, bounds = 0, sorted((a, b) for a, _, b in base)
    for a, b in sorted(values.union(m.span() for m in _digit_runs(text)), key=lambda s: (s[0], -s[1])):
        while k < len(bounds) and bounds[k][1] <= a:
            k += 1
        if b - a < 6 or (out and a < out[-1][1]):
            continue
        if not (k < len(bounds) and bounds[k][0] < b) or ((a, b) in values and 2 * _covered(bounds, k, a, b) < b - a):
            out.append((a, b))
    return out


def _values(text: str):
    """Places of the whole values that a colon or an equals sign introduces."""
    at = 0
    while m := _FIELD.search(text, at):
        a, b = m.span(m.lastgroup)
        if m.lastgroup == "c":
            b = a + len(m.group("c").rstrip(".,;:!?)]}>"))
        if b > a:
            yield a, b
        at = m.end()


def _covered(bounds: list[tuple[int, int]], k: int, a: int, b: int) -> int:
    """Code points of ``a`` to ``b`` that lie in the spans from the ``k``-th on."""
    n = 0
    while k < len(bounds) and bounds[k][0] < b:
        n += max(0, min(bounds[k][1], b) - max(bounds[k][0], a))
        a, k = max(a, bounds[k][1]), k + 1
    return n


def _digit_runs(text: str):
    """Whole runs around digits, found from their first digit so that other words cost nothing."""
    at = 0
    while d := _DIGIT.search(text, at):
        start = d.start()
        while start > at and text[start - 1].isascii() and text[start - 1].isalnum():
            start -= 1
        m = _RUN.match(text, start)
        yield m
        at = m.end()


#: Labelers: pattern of a long hex run; pattern of grouped numbers; gazetteer of field names; assignment or quotes
#: around; mixed signs; and against: short or round numbers; plain words; digits that fail their checksum.
LABELERS = 8


def describe(text: str, a: int, b: int) -> tuple[int, int]:
    """The candidate's votes (two bits each: 0 none, 1 yes, 2 no) and its feature code."""
    span = text[a:b]
    before = text[max(0, a - NEAR) : a]
    words = [w.lower() for w in _WORD.findall(before)][-2:]
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    hexed = bool(_HEX.fullmatch(span))
    quoted = before[-1:] in "\"'" and text[b : b + 1] in "\"'" and before != ""
    assigned = before.rstrip(" \"'")[-1:] in (":", "=")
    field = next((k for k, names in enumerate((SECRET_FIELDS, ID_FIELDS, CONTACT_FIELDS), 1) if not names.isdisjoint(words)), 0)
    grouped = bool(_GROUPS.fullmatch(span))
    size, share = len(span), digits / len(span)
    votes = (
        1 if hexed and letters and size >= 24 else 0,
        1 if grouped else 0,
        1 if field else 0,
        1 if assigned and quoted else 2 if not assigned and not quoted else 0,
        1 if letters and digits >= 4 and size >= 16 else 0,
        2 if not letters and size <= 6 else 0,
        2 if digits == 0 else 0,
        2 if not letters and 12 <= digits <= 19 and not grouped else 0,
    )
    features = (min(size // 8, 5), min(int(share * 4), 3), int(letters > 0), int(hexed), int(quoted), int(assigned), field, int(grouped))
    code = 0
    for value, n in zip(features, SIZES, strict=True):
        code = code * n + value
    return sum(v << 2 * k for k, v in enumerate(votes)), code


#: Values of each feature; their product bounds the codes.
SIZES = (6, 4, 2, 2, 2, 2, 4, 2)


def one_hot(codes: np.ndarray) -> np.ndarray:
    columns, rest = [], codes.copy()
    for n in SIZES[::-1]:
        columns.append(np.eye(n)[rest % n][:, 1:])
        rest //= n
    return np.hstack([np.ones((len(codes), 1)), *columns])


def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: P(vote | class) of each labeler and P(personal | pattern)."""
    v = votes[:, None] >> 2 * np.arange(LABELERS) & 3
    posterior = ((v == 1).sum(1) + 0.5) / ((v > 0).sum(1) + 1.0)  # the majority
    for _ in range(rounds):
        table = np.empty((2, LABELERS, 3))
        for c, p in enumerate((1 - posterior, posterior)):
            for x in range(3):
                table[c, :, x] = (((v == x) * (p * count)[:, None]).sum(0) + (1.0 if x == 0 else 0.5 + (x == 2 - c))) / ((p * count).sum() + 3)
        prior = ((posterior * count).sum() + 1) / (count.sum() + 2)
        table /= table.sum(2, keepdims=True)
        log = [np.log(q) + np.log(table[c, np.arange(LABELERS), v]).sum(1) for c, q in enumerate((1 - prior, prior))]
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return table, posterior


def span_model(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Weights of the span classifier from rows of vote pattern, feature code and count."""
    if not counts:
        return np.zeros(one_hot(np.zeros(1, int)).shape[1])
    votes, codes, n = np.array(counts, np.int64).T
    pattern, at = np.unique(votes, return_inverse=True)
    _, likely = reliabilities(pattern, np.bincount(at, n))
    x, y, weight = one_hot(codes), likely[at], n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (weight * (y - p)) - 1e-3 * w)
        w += np.clip(step, -5, 5)
    return w


def personal(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return one_hot(codes) @ weights >= 0 if weights.any() else np.zeros(len(codes), bool)


def _kind(code: int) -> int:
    return 4 if code // int(np.prod(SIZES[3:])) % 2 else 5


def gathered(docs: DataFrame) -> DataFrame:
    """``doc_id, base, found``: base spans, and candidates with votes and code. One pass over the texts."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        base, found = [], []
        for t in texts(b):
            spans = base_spans(t)
            base.append([{"start": a, "kind": k, "stop": z} for a, k, z in spans])
            found.append([dict(zip(("start", "stop", "votes", "code"), (a, z, *describe(t, a, z)), strict=True)) for a, z in candidates(t, spans)])
        return batch_of(schema, b.column("doc_id"), base, found)

    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])
    mark = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("votes", pa.int32()), ("code", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("found", pa.list_(mark))])
    ddl = "doc_id long, base array<struct<start:long,kind:int,stop:long>>, found array<struct<start:long,stop:long,votes:int,code:int>>"
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, ddl)


def train(found: DataFrame) -> np.ndarray:
    """The span classifier from the candidates of all documents; at most patterns x codes rows reach the driver."""
    counts = found.select(F.explode("found").alias("x")).groupBy("x.votes", "x.code").agg(F.count(F.lit(1)).alias("n"))
    return span_model(sorted((r["votes"], r["code"], r["n"]) for r in counts.collect()))


def _accepted(marks: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    if not marks:
        return []
    yes = personal(np.array([m[2] for m in marks]), weights)
    return [(a, _kind(code), b) for (a, b, code), keep in zip(marks, yes.tolist(), strict=True) if keep]


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs`` with base and accepted spans replaced in ``text``; ``n_chars`` follows where there is one."""
    weights = train(stored(gathered(docs.select("doc_id", "text")), "pii-candidates")) if weights is None else weights

    def fn(b: pa.RecordBatch) -> list:
        out = []
        for t in b.column("text").to_pylist():
            if t is None:
                out.append(None)
                continue
            base = base_spans(t)
            marks = [(a, z, describe(t, a, z)[1]) for a, z in candidates(t, base)]
            spans = base + _accepted(marks, weights)
            out.append(redact(t, spans) if spans else t)
        return [out]

    found, (name,) = add_columns(docs, fn, "redacted string")
    new = {"text": F.col(name), "n_chars": F.char_length(F.col(name)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if new.get(c) is not None else F.col(c) for c in docs.columns])


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(gathered(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pii-candidates")
    weights = train(found)

    def fn(batches):
        for b in batches:
            base = [[(x["start"], x["kind"], x["stop"]) for x in row] for row in b.column("base").to_pylist()]
            added = [_accepted([(x["start"], x["stop"], x["code"]) for x in row], weights) for row in b.column("found").to_pylist()]
            counts = [[sum(k == kind for _, k, _ in row) for row in base] for kind in range(4)]
            digest = [hashlib.sha256(_named(row).encode()).hexdigest() for row in base]
            yield batch_of(schema, b.column("doc_id"), *counts, digest, [_named(x + y) for x, y in zip(base, added, strict=True)])

    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("spans", pa.string())])
    return arrow(found, fn, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
