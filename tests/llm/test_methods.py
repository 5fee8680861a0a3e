"""Operators against plain versions of their methods, and files read by another session."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import license_templates as lt
from pagemill.llm import simhash, token_output, toxicity

from .test_queries import documents, prose, query

_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(_LOW))


# --- classifier chain -----------------------------------------------------------------------

def plain_score(chain, text):
    """Sums over words and beginnings, one link after the other, without arrays."""
    top, count, out = (1 << toxicity.BITS) - 16, {}, []
    for w in words_of(text):
        keys = [zlib.crc32(w.encode())] + [zlib.crc32(b"%d" % k + w[:k].encode()) for k in toxicity.BEGINNINGS if len(w) > k]
        for key in keys:
            count[key % top] = count.get(key % top, 0) + 1
    for link in chain:
        s = sum(link[p] * math.log(1 + n) for p, n in count.items()) + link[top] + sum(link[top + 1 + k] * p for k, p in enumerate(out))
        out.append(1 / (1 + math.exp(-s)))
    return out


def test_op4_probabilities_equal_plain_ones(spark, sf_dir, hard):
    for d in (sf_dir, hard):
        chain = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
        texts = documents(spark, d)
        for r in query("op4_classifier_chain")(spark, d).where("doc_id is not null").collect():
            want = plain_score(chain, texts[r.doc_id])
            assert np.allclose([r[f"p_{name}"] for name in toxicity.CATEGORIES], want, atol=1e-9)
            assert r.toxic == (want[-1] > toxicity.REJECT)


def test_op4_kinds_come_from_the_rows():
    known, rng = toxicity.Words(), random.Random(4)
    bad = (["blorp", "snarg"], ["quixle", "vandrop"])  # made up: no list of words could hold them
    texts, toxic, kind = [], [], []
    for i in range(600):
        t, k = prose(i), rng.choice((None, None, 0, 0, 1))
        texts.append(t if k is None else t + " " + " ".join(bad[k]))
        toxic.append(int(k is not None))
        kind.append(k)
    rows, y = [toxicity.features(t.encode(), known) for t in texts], np.array(toxic)
    found = toxicity.kinds(rows, y, np.arange(600) % 3)
    assert [m.tolist() for m in found] == [[int(k == 0) for k in kind], [int(k == 1) for k in kind]]
    none = toxicity.kinds(rows, np.zeros(600, int), np.arange(600) % 3)
    assert not np.array(none).any()
    one = toxicity.kinds(rows[:3], np.array([1, 0, 0]), np.arange(3))
    assert sum(m[0] for m in one) == 1


# --- template markup ------------------------------------------------------------------------

def as_regex(template):
    """The template as a regular expression over words that each have a space behind them."""
    out, at = [], 0
    for m in [*re.finditer(r"<<(.*?)>>", template), None]:
        out += [re.escape(w) + " " for w in words_of(template[at : m.start() if m else None])]
        if m is None:
            return re.compile("(?<= )" + "".join(out))
        at = m.end()
        most = re.search(r"max=(\d+)", m[1])
        out.append("(?:" if m[1] == "beginOptional" else ")?" if m[1] == "endOptional" else r"(?:\S+ ){0,%d}" % int(most[1]))


def plain_labels(text, patterns):
    joined = " " + "".join(w + " " for w in words_of(text))
    found = {(m.start(), label, m.end()) for label, p in patterns for m in p.finditer(joined)}
    tags = [x for x in found if x[1].startswith("spdx:")]
    return {x[1] for x in found if x not in tags or x[2] == max(t[2] for t in tags if t[0] == x[0])}


def made_up(template, rng, over):
    """The template's wording with a choice for each region; ``over``: sometimes with a word too many."""
    s = re.sub(r"<<var[^>]*max=(\d+)>>", lambda m: " ".join(rng.choice(("Foo", "of", "1")) for _ in range(rng.randint(0, int(m[1]) + (over and rng.random() < 0.2)))), template)
    while (t := re.sub(r"<<beginOptional>>((?:(?!<<).)*)<<endOptional>>", lambda m: m[1] if rng.random() < 0.5 else "", s, flags=re.S)) != s:
        s = t
    return s


def test_op6_labels_equal_a_plain_matcher(spark, sf_dir, hard):
    patterns = [(label, as_regex(t)) for label, t in lt.all_templates()]
    for d in (sf_dir, hard):
        texts = documents(spark, d)
        for r in query("op6_template_markup")(spark, d).where("doc_id is not null").collect():
            base = {label for p, label in lt.PHRASES.items() if f" {p} " in f" {' '.join(words_of(texts[r.doc_id]))} "}
            more = plain_labels(texts[r.doc_id], patterns)
            assert r.labels == ",".join(sorted(base | more)) and r.score == (1 if more else 0.5 if base else 0)
    scan, rng = lt.Scanner(), random.Random(7)
    for damaged in (False, True, True):
        for label, t in lt.all_templates():
            words = made_up(t, rng, damaged).split()
            if damaged and rng.random() < 0.5:
                words[rng.randrange(len(words))] = "swapped"
            text = f"{prose(rng.randrange(99))} {', '.join(words).upper()}. {prose(1)}"
            got = {x for _, _, x in scan.scan(text.encode())[2]}
            assert got == plain_labels(text, patterns)
            assert damaged or label in got


@pytest.mark.parametrize("text, labels", [
    ("SPDX-License-Identifier: MIT-0", {"spdx:MIT-0"}),
    ("// SPDX-License-Identifier: GPL-2.0-or-later */", {"spdx:GPL-2.0-or-later"}),
    ("SPDX-License-Identifier: NoSuch-1.0", set()),
    ("This work is under Creative Commons Attribution-ShareAlike 4.0 International.", {"cc-by-sa-4.0"}),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", {"cc-by-nc-nd-4.0"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", {"lgpl"}),
])
def test_op6_known_wording(text, labels):
    assert {x for _, _, x in lt.Scanner().scan(text.encode())[2]} == labels


def test_op6_takes_templates_and_any_id(spark):
    docs = spark.createDataFrame([("a", "use it as YOU like"), ("b", "use it as they like"), (None, None)], "doc_id string, text string")
    own = (("own", "use it as <<var;name=who;max=1>> like"), ("own", "no such wording"))
    rows = {r.doc_id: r for r in lt.scanned(docs, templates=own).collect()}
    assert [x.label for x in rows["a"].templates] == ["own"] == [x.label for x in rows["b"].templates] and rows[None].n_words == 0
    assert lt.scanned(docs, templates={"x": "as you"}).where(F.size("templates") > 0).count() == 1


# --- token files ----------------------------------------------------------------------------

def test_op8_files_are_read_by_another_session(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _ in range(2):  # a second run replaces the first
        token_output.write(docs, folder)
    got = sorted(map(tuple, token_output.read(spark.newSession(), folder).collect()))
    assert got == sorted(map(tuple, query("op8_ranked_vbyte")(spark, sf_dir).collect()))
    ranks = token_output.rank_table(spark, folder)
    n = {r.id: r.n for r in token_output.id_counts(token_output.encoded(docs)).collect()}
    assert ranks.tolist() == sorted(range(len(ranks)), key=lambda i: (-n.get(i, 0), i))


def test_op8_copies_of_one_row_are_several_files_work(spark, tmp_path):
    rows = [(5, "the same row again")] * 3000 + [(i, prose(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    docs.write.parquet(str(tmp_path / "docs"))
    per_file = token_output.encoded(spark.read.parquet(str(tmp_path / "docs")), files=8).where("doc_id = 5").groupBy("file").count().collect()
    assert len(per_file) > 2 and sum(r["count"] for r in per_file) >= 3000 and max(r["count"] for r in per_file) < 2000
    folder = str(tmp_path / "out")
    token_output.write(spark.read.parquet(str(tmp_path / "docs")), folder)
    at = 0
    for r in token_output.read(spark, folder).orderBy("start").collect():
        assert r.start == at
        at += r.n_tokens


def test_op8_other_vocabularies_go_through_the_library():
    from tokenizers import Tokenizer

    path = token_output._vocabulary().replace("word_bpe_49k", "byte_bpe_50k")
    lib, own = Tokenizer.from_file(path), token_output.Words(path)
    cases = ["Hello World  twice\n", "", "MIXED case 12 é世", "a<|endoftext|>b"]
    assert not own.by_word and token_output.load(token_output._vocabulary()).by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(cases)] == [lib.encode(t, add_special_tokens=False).ids for t in cases]


# --- fingerprints ---------------------------------------------------------------------------

def test_op5_a_full_bucket_is_dealt_to_several_tasks(spark):
    rng = random.Random(9)
    high = 0x5AAA5AAA << 32
    codes = list({high | rng.getrandbits(20) for _ in range(3000)})  # all share 44 bits
    df = spark.createDataFrame([(c,) for c in codes], "fp long").repartition(4)
    bucketed = simhash.buckets(df, 200)
    sizes = [r["count"] for r in bucketed.groupBy("bucket").count().collect()]
    assert max(sizes) < 2000
    star = {r.node: r.root for r in simhash.stars(simhash.forest(bucketed)).collect()}
    arr = np.array(codes, np.uint64)
    for c in rng.sample(codes, 60):
        near = arr[np.bitwise_count(arr ^ np.uint64(c)) <= simhash.MOST]
        assert len({star.get(int(x), int(x)) for x in near}) == 1
