"""Decontamination against a plain version and its SQL, and the pipeline stage by stage."""

import re
import random
import tracemalloc
from collections import Counter

import corpus_pipeline
import pytest
from pagemill.llm import decontaminate

from .conftest import ITEM, ROWS, prose
from .test_queries import LOW, components, plain_fingerprint


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(text, items):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        v = words(t)
        k = min(13, len(v))
        for s in range(len(v) - k + 1) if v else ():
            for p in range(len(w) - k + 1):
                if w[p : p + k] == v[s : s + k]:
                    hit.update(range(p, p + k))
                    names.add(name)
    return len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [10, 1 << 20])
def test_op2_against_plain(spark, hard, block):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    bench = spark.read.parquet(f"{hard}/benchmark.parquet")
    items = [(i, t) for i, t in bench.select("item_id", "text").collect() if i is not None and t]
    found, names = decontaminate.located(docs, bench, block=block)
    assert found.columns[: len(docs.columns)] == docs.columns and found.count() == docs.count()
    for r in found.collect():
        n, hit, named, _ = plain(r["text"], items)
        got = sum(s["stop"] - s["start"] for s in r[names[1]])
        assert (r[names[0]], got, r[names[2]]) == (n, hit, named)
    kept = decontaminate.clean(docs, bench)
    want = Counter(r[0] for r in ROWS if not plain(r[1], items)[3])
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == want


def test_op2_longest_match(spark):
    long = prose(5, 40)
    docs = spark.createDataFrame([(1, "before " + long + " behind"), (2, " ".join(long.split()[3:20])), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "other " + long), (2, ITEM)], "item_id long, text string")
    found, names = decontaminate.located(docs, bench)
    assert {r["doc_id"]: r[names[3]] for r in found.collect()} == {1: 40, 2: 17, 3: 0}


@pytest.mark.parametrize("window", [3, 13])
def test_op2_longest_against_plain(window):
    """Longest matches and spans of random texts of few words, copies and repeats included, against a plain search."""
    r = random.Random(window)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    for _ in range(60):
        items = [(i, text(r.randrange(1, 30)).encode()) for i in range(4)] + [(9, b"a a a a a a a a a a a a a a a a a a")]
        docs = [text(r.randrange(0, 60)) for _ in range(5)] + ["a " * 40, items[0][1].decode(), "x a b", ""]
        q = decontaminate.Suffixes(items, window)
        spans, named, longest = decontaminate.matches(decontaminate.Shard([d.encode() for d in docs], q), q)
        for d, t in enumerate(docs):
            w, hit, names, most = t.split(), set(), set(), 0
            for name, x in items:
                v = x.decode().split()
                for p in range(len(w)):
                    for s in range(len(v)):
                        n = 0
                        while p + n < len(w) and s + n < len(v) and w[p + n] == v[s + n]:
                            n += 1
                        if n >= min(window, len(v)):
                            names.add(name)
                            most = max(most, n)
                            hit.update(range(p, p + n))
            assert {x for e, a, b in spans if e == d for x in range(a, b)} == hit
            assert {q.names[i] for i in named.get(d, ())} == names and longest.get(d, 0) == most


def test_op2_one_word_repeated():
    """Neither time nor memory grows with the product of the repeats."""
    q = decontaminate.Suffixes([(1, b"word " * 300), (2, b"word " * 13)])
    shard = decontaminate.Shard([b"word " * 200_000], q)
    tracemalloc.start()
    spans, named, longest = decontaminate.matches(shard, q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans == [(0, 0, 200_000)] and named == {0: {0, 1}} and longest == {0: 300} and peak < 400 << 20


def test_op2_ids_of_any_type(spark):
    docs = spark.createDataFrame([("d", ITEM), ("e", "nothing")], "doc_id string, text string")
    found, names = decontaminate.located(docs, spark.createDataFrame([("i-1", ITEM), ("i-2", "?")], "item_id string, text string"))
    assert {r["doc_id"]: r[names[2]] for r in found.collect()} == {"d": ["i-1"], "e": []}


def test_op2_sql(spark, sf_dir):
    import check_oracles as check
    import duckdb
    from pagemill.llm.plans import ORACLES, QUERIES

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf_dir)
        cur = con.execute(sql)
        assert check.rows(df.columns, [tuple(r) for r in df.collect()]) == check.rows([d[0] for d in cur.description], cur.fetchall())


def test_stages(spark, sf_dir, hard):
    """Each stage on its own input: columns stay, decisions take effect, clean rows stay."""
    for d in (sf_dir, hard):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            before = docs.collect()
            out = stage(spark, docs, d)
            rows = out.collect()
            if name == "bpe":
                assert len(rows) == len(before)
                break
            assert out.columns == docs.columns
            if name == "simhash_near_dedup":
                codes = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in before if r["doc_id"] is not None}
                assert Counter(r["doc_id"] for r in rows) == Counter([*set(components(codes).values()), *[r["doc_id"] for r in before if r["doc_id"] is None]])
            elif name == "benchmark_decontamination":
                items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if r["item_id"] is not None]
                assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in before if not plain(r["text"], items)[3])
            elif name == "pii":
                assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in before)
                if "n_chars" in out.columns:
                    assert all(r["n_chars"] == len(r["text"]) for r in rows)
            docs = out


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert 0 < rows.count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
