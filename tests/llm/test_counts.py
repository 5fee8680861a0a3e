"""Collocations, alignment and URL verdicts against plain versions."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pagemill.llm import alignment, phrases, plans, url_filter

from .conftest import PAGES
from .test_queries import LOW


def rows_of(spark, sf_dir, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns).collect()]


def plain_phrases(rows, least, top, longest=5, subsumed=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[1:][i : i + m]) for p, a in found.items() for m in range(2, len(p) - 1) for i in range(len(p) - m) if 100 * a >= subsumed * f[(p[0], *p[1:][i : i + m])]}
    out = []
    for (lang, *w), a in found.items():
        if (lang, *w) not in gone:
            score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    ranked = []
    for lang in n:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (x[1], x[2], x[3].encode()))[:top]
        ranked += [(lang, i, p, -a, left, right, n[lang], -score) for i, (_, score, a, p, left, right) in enumerate(best, 1)]
    return sorted(ranked)


def test_op11_against_plain(spark, sf_dir, hard):
    for d in (sf_dir, hard):
        got = sorted(tuple(r) for r in plans.QUERIES["op11_stripes"](spark, d).collect())
        assert got and got == plain_phrases(rows_of(spark, d, "lang", "text"), phrases.LEAST, phrases.TOP)


@pytest.mark.parametrize("most_bits, subsumed, top", [(1 << 20, 100, 2000), (1 << 10, 60, 7)])
def test_op11_low_thresholds(spark, monkeypatch, most_bits, subsumed, top):
    """Many phrases, a bitmap that is full, stripes handed on often, subsumption by a share, ties at the cut-off."""
    monkeypatch.setattr(phrases, "LEAST_BITS", 1 << 10)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, ""]), "".join(rng.choice(["x ", "y ", "z\t", "Z ", "x, ", "é\n", "w; "]) for _ in range(rng.randint(0, 60)))) for _ in range(400)] + [("a", None)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as n", "2 as prefix").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=6, top=top, subsumed=subsumed, most_bits=most_bits).collect())
    assert got and got == plain_phrases(rows, 6, top, subsumed=subsumed)


def test_op11_clashing_keys_are_seen(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("b", 1, "x")]
    clash = spark.createDataFrame(rows, "lang string, key long, word string")
    assert phrases._shared(clash, "lang", "key") and not phrases._shared(clash.where("word = 'x'"), "lang", "key")
    rows = [("en", "fr fr es"), ("fr", "en en es"), ("es", "en fr")] * 6  # words spelled like languages
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 5, 2000)
    with pytest.raises(ValueError):  # no seed left to try
        phrases.frequent(spark.createDataFrame([("a", "x y")], "lang string, text string"), seeds=range(0))


def test_op11_long_tasks_do_not_merge_all_for_each_slice(monkeypatch):
    """What a task holds is merged when it has grown by a part of itself, and phrases that share a key stay apart."""
    monkeypatch.setattr(phrases, "MERGE", 1000)
    monkeypatch.setattr(phrases, "HOLD", 100_000)
    merges, merge = [], phrases.Held.merge
    monkeypatch.setattr(phrases.Held, "merge", lambda self: (merges.append(1), merge(self))[1])
    held = phrases.Held()
    for i in range(200):
        key = np.arange(100 * i, 100 * i + 100, dtype=np.uint64)
        held.add(key, key, key)
    assert len(merges) < 20

    held = phrases.Held()
    one = np.ones(3, np.uint64)
    held.add(one, np.array([5, 6, 5], np.uint64), one)
    held.add_totals(one)
    found = Counter()
    for b in held.stripes():
        for r in b.to_pylist():
            found.update({(p, x): n for p, x, n in zip(r["prefix"], r["next"], r["n"], strict=True)})
    assert found == {(5, 1): 2, (6, 1): 1, (1, 0): 3}


def test_op11_words_of_any_length(spark):
    """Hashes by eights and of long words one by one; borders within wide gaps."""
    long = [c * n for n in (1, 7, 8, 9, 16, 17, 31, 32, 33, 34, 100) for c in "aé"] + ["a" * 32 + "b", "a" * 32 + "c"]
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), "".join(rng.choice(long) + rng.choice([" ", "  ", " \t ", " , ", ". ", "\n\n"]) for _ in range(40))) for _ in range(150)]
    rows += [("c", " ,x y"), ("c", ""), ("a", ". ")]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=3).collect())
    assert got and got == plain_phrases(rows, 3, phrases.TOP)
    raw = np.frombuffer("".join(long).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in long])
    keys = phrases.Keys(1).words(raw, np.append(0, ends[:-1]), ends)
    assert len(set(keys.tolist())) == len(long) and keys.tolist() != phrases.Keys(2).words(raw, np.append(0, ends[:-1]), ends).tolist()


def plain_alignment(rows):
    """Counts by walking both token lists side by side."""
    v, found, count = alignment.load(None, None), [], Counter()
    for key, text in rows:
        (a,), (b,) = v.encode([text or ""])
        spans = []
        for ids, sizes in ((a, v.a_bytes), (b, v.b_bytes)):
            ends = np.cumsum([len(sizes[i]) for i in ids]).tolist() if ids else []
            spans.append(list(zip([0, *ends], ends, ids)))  # noqa: B905
        links, j = [], 0
        for start, stop, i in spans[0]:
            while spans[1][j][1] <= start:
                j += 1
            m = j
            while m < len(spans[1]) and spans[1][m][0] < stop:
                links.append((i, spans[1][m][2]))
                m += 1
        common = {z for _, z, _ in spans[0]} & {z for _, z, _ in spans[1]}
        sides = [[[]], [[]]]
        for side, tokens in zip(sides, spans, strict=True):
            for _, stop, i in tokens:
                side[-1].append(str(i))
                if stop in common:
                    side.append([])
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True) if x)
        found.append((key, len(a), len(b), len(common), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
        count.update(set(links))
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return Counter((key, na, nb, ng, len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), g) for key, na, nb, ng, x, g in found)


def test_op12_against_plain(spark, sf_dir, hard):
    for d in (sf_dir, hard):
        got = Counter(tuple(r) for r in plans.QUERIES["op12_perfect_hash_alignment"](spark, d).collect())
        assert got == plain_alignment(rows_of(spark, d, "doc_id", "text"))


def test_op12_segments_groups_and_odd_texts(spark):
    """Several segments, a group for each two of them; ids of another type; special tokens, odd spaces and signs as plain text."""
    rng = random.Random(7)
    signs = ["the ", "ing", "é", "世", "🙂", " ", "\n", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "▁", "\u00a0", "ﬁ", "\x00", "'s ", "123"]
    rows = [(f"k{i}", "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))) for i in range(300)] + [("k1", "the"), (None, None), ("a", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as a", "2 as pair").repartition(6)
    got = alignment.aligned(docs, segment=100, group=200)
    want = plain_alignment(rows)
    assert Counter(tuple(r) for r in got.collect()) == want and sum(r[1] == 0 for r in want) > 2


def test_op12_encoders_agree():
    v, rng = alignment.load(None, None), random.Random(9)
    assert v.quick is not None
    signs = "ab e's\n\t 12é世🙂<|endoftext|>tTHÉ \x1c\x85.,!-\u00a0\u3000"
    cases = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["1" * 100_000, " " * 100_000 + "x", "a" * 999 + " " * 998]
    assert v._encode_a(cases) == [v.a.encode(t, add_special_tokens=False).ids for t in cases]


def test_op12_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        numbers = np.unique(rng.integers(0, 1 << 40, n))
        made = alignment.Perfect.build(rng.permutation(numbers))
        place = made.find(numbers)
        assert sorted(place.tolist()) == list(range(len(numbers))) and (made.keys[place] == numbers).all()
        foreign = np.setdiff1d(rng.integers(0, 1 << 40, 500), numbers)
        assert (made.find(foreign) == -1).all()
    for top in (0, 255, 256, 70_000, 1 << 40):
        counts = np.array([0, 1, top])
        assert (alignment._wide(alignment._narrow(counts)) == counts).all()


def plain_url(url, listed):
    host = path = ""
    form = None
    if url and "://" in url:
        host, path, query = re.match(r"(?s)([^/?#]*)([^?#]*)(?:\?([^#]*))?", url.split("://", 1)[1]).groups()
        host = host.translate(LOW)
        site = re.sub(r"^[^@]*@", "", host)
        site = re.sub(r":(80|443)?$", "", site)
        query = "&".join(sorted((q for q in (query or "").split("&") if q and not re.match(url_filter.TRACKING, q)), key=str.encode))
        form = re.sub(r"^www\.", "", site) + path.rstrip("/") + ("?" + query if query else "")
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2], form
    return host, path, None, "block" if form is not None and form in listed else "allow", form


def test_op13_against_plain(spark, sf_dir, hard):
    for d in (sf_dir, hard):
        urls = [(r.page_id, r.url) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
        listed = {plain_url(u, ())[4] for _, u in urls if set(re.split("[.-]", plain_url(u, ())[0])) & set(url_filter.UNWANTED)} - {None}
        want = Counter((i, *plain_url(u, listed)[:4]) for i, u in urls)
        got = Counter(tuple(r) for r in plans.QUERIES["op13_blocked_bloom"](spark, d).collect())
        assert got == want and any(r[3] is None and r[4] == "block" for r in got)


@pytest.mark.parametrize("most_bytes", [64, 1 << 20])
def test_op13_full_filter_and_hot_url(spark, hard, most_bytes):
    """A filter far too small for its list lets rows through, never a wrong verdict; columns of any name stay."""
    hot = [(i, "https://x.example.org/hot?utm_id=" + str(i % 3), None, None, None) for i in range(300)]
    other = [(1000 + i, f"https://x.example.org/{i}", None, None, None) for i in range(300)]
    pages = spark.createDataFrame(PAGES + hot + other, "page_id long, url string, html string, host string, __salt int")
    listed = spark.createDataFrame([("x.example.org/hot",), ("http://x.example.org/hot/",), (None,), *[(f"http://x.example.org:80/{2 * i}",) for i in range(400)]], "url string")
    found, names = url_filter.judged(pages, listed, most_bytes=most_bytes)
    assert found.columns == [*pages.columns, *names] and names == ["host_", "path", "rule", "verdict"]
    forms = {"x.example.org/hot", *(f"x.example.org/{2 * i}" for i in range(400))}
    want = Counter((r[0], r[1], *plain_url(r[1], forms)[:4]) for r in PAGES + hot + other)
    assert Counter(tuple(r) for r in found.select("page_id", "url", *names).collect()) == want
    free, names = url_filter.judged(pages, listed.limit(0))
    assert free.where(f"{names[2]} is null and {names[3]} = 'block'").count() == 0


def test_op13_rules():
    with pytest.raises(ValueError):
        url_filter.rule_of(None, None, (("allow", "a", "/"), ("block", "a", "/")))


def test_sql_on_hard_rows(spark, hard):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{hard}/{t}.parquet/*.parquet'")
    for name in ("op11_stripes", "op13_blocked_bloom"):
        df = plans.QUERIES[name](spark, hard)
        cur = con.execute(plans.ORACLES[name])
        assert [d[0] for d in cur.description] == df.columns
        assert Counter(tuple(r) for r in df.collect()) == Counter(cur.fetchall())
