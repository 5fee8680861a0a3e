"""License scans by template markup: optional and replaceable regions compiled into token automata.

A template is license wording with ``<<beginOptional>> ... <<endOptional>>`` around what may be missing and
``<<var;name=...;max=N>>`` where up to N words of any kind may stand. It is compiled into an automaton over words
(A-Z lower-cased); a text is accepted at a place if all mandatory words stand there exactly, in order, with nothing
between them but what the markup allows. Case, punctuation and white space don't matter.

A text is run through an automaton only where it can start, and only if the text has the template's rarest-looking
mandatory word at all; so most texts cost one scan for a few byte strings and the count of their words.

Edge cases: a null or wordless text has no words, no labels and score 0; long texts are scanned whole, with a bounded
number of live states; repeated rows each get their result; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import LETTERED, batch_of, map_slices, raw_texts

#: Phrases that are looked for anywhere, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_AS_IS = """the software is provided <<var;name=quote;max=2>> without warranty of any kind express or implied including
but not limited to the warranties of merchantability fitness for a particular purpose and <<beginOptional>>non infringement<<endOptional>>
<<beginOptional>>noninfringement<<endOptional>> in no event shall the <<var;name=holders;max=12>> be liable for any claim damages or
other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
or the use or other dealings in the software"""

# Wording of public licenses and their usual notices, with markup.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
license you may obtain a copy of the license at <<var;name=address;max=8>> unless required by applicable law or agreed to in writing
software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either
express or implied see the license for the specific language governing permissions and limitations under the license""",
    "cc-by-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by 4 0",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by sa 4 0",
    "gpl-2.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license version 2",
    "gpl-3.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license version 3",
    "gpl-header": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
published by the free software foundation <<beginOptional>>either<<endOptional>> version <<var;name=version;max=1>> of the license
<<beginOptional>>or at your option any later version<<endOptional>>""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
<<beginOptional>>provided that the above copyright notice and this permission notice appear in all copies<<endOptional>>
the software is provided <<var;name=quote;max=2>> and the author disclaims all warranties with regard to this software""",
    "mit-notice": "<<beginOptional>>this software is<<endOptional>> <<beginOptional>>distributed<<endOptional>> <<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
files the software to deal in the software without restriction including without limitation the rights to use copy modify merge
publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
subject to the following conditions the above copyright notice and this permission notice
<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software """ + _AS_IS,
}

_PROVIDED = """this software is provided by <<var;name=holders;max=15>> <<var;name=quote;max=2>> and any express or implied warranties including
but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
are met <<var;name=bullet;max=2>> redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer <<var;name=bullet;max=2>> redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with the distribution """
_ENDORSE = """<<var;name=bullet;max=2>> neither the name of <<var;name=holder;max=15>> nor the names of <<var;name=whose;max=4>> may be used to
endorse or promote products derived from this software without specific prior written permission """
_GNU = """free software you can redistribute it and or modify it under the terms of the gnu """
_ISSUED = """ as published by the free software foundation <<beginOptional>>either<<endOptional>> version """

# Further licenses by their text, the notice that goes with them, or their title; (label, wording) pairs.
NOTICES = (
    ("bsd-2-clause", _BSD + _PROVIDED),
    ("bsd-3-clause", _BSD + _ENDORSE + _PROVIDED),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0 1 definitions"),
    ("gpl-2.0", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007"),
    ("lgpl", "this <<var;name=what;max=2>> is " + _GNU + "lesser general public license" + _ISSUED),
    ("lgpl", "this <<var;name=what;max=2>> is " + _GNU + "library general public license" + _ISSUED),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", "this program is " + _GNU + "affero general public license" + _ISSUED + "3"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("epl-1.0", "made available under the terms of the eclipse public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 1 0"),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "made available under the terms of the eclipse public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl-1.2", "licensed under the eupl <<beginOptional>>version<<endOptional>> 1 2"),
    ("ms-pl", "microsoft public license ms pl this license governs use of the accompanying software"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("bsl-1.0", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license the software to use reproduce display distribute execute and transmit the software"""),
    ("zlib", """this software is provided <<var;name=quote;max=2>> without any express or implied warranty in no event <<var;name=will;max=4>> be held
liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
commercial applications and to alter it and redistribute it freely"""),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("artistic-2.0", "the artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    ("upl-1.0", "the universal permissive license upl version 1 0"),
    ("mulanpsl-2.0", "licensed under mulan psl v2"),
    ("odbl-1.0", "open data commons open database license <<beginOptional>>odbl<<endOptional>> <<beginOptional>>v<<endOptional>> 1 0"),
    ("odc-by-1.0", "open data commons attribution license <<beginOptional>>odc by<<endOptional>> <<beginOptional>>v<<endOptional>> 1 0"),
    ("elastic-2.0", "elastic license 2 0"),
    ("busl-1.1", "business source license 1 1"),
    ("sspl-1.0", "server side public license version 1 october 16 2018"),
    ("cc0-1.0", "cc0 1 0 universal"),
    ("cc0-1.0", "to the extent possible under law <<var;name=who;max=20>> has waived all copyright and related or neighboring rights to"),
)

# The parts of the Creative Commons licenses' names, and identifiers of the public license list.
_CC_PARTS = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
_CC = ("by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd")
SPDX = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1
CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0
EUPL-1.2 GFDL-1.3-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later
LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Ruby
Unlicense UPL-1.0 Vim WTFPL X11 Zlib""".split()
_TAG = "spdx:"


def all_templates() -> list[tuple[str, str]]:
    """Label and wording of everything known: texts and notices, names of Creative Commons licenses, and identifier tags."""
    words = lambda name: re.sub(r"[-.]", " ", name).lower()
    names = []
    for kind in _CC:
        parts = " ".join(_CC_PARTS[p] for p in kind.split("-")[1:])
        names += [(f"cc-{kind}-{v}", f"creative commons attribution {parts} {words(v)}") for v in ("2.0", "2.5", "3.0", "4.0")]
    return [*TEMPLATES.items(), *NOTICES, *names, *((_TAG + i, f"spdx license identifier {words(i)}") for i in SPDX)]


_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


class Automaton:
    """A template as states: state i holds the words that lead on from it. Skips are resolved at compile time."""

    def __init__(self, template: str):
        self.steps: list[tuple[bytes | None, int]] = []  # a word, or None with the most words it stands for
        opened: list[int] = []
        jumps: dict[int, list[int]] = {}
        optional: set[int] = set()
        at = 0
        for m in [*_MARK.finditer(template), None]:
            for w in LETTERED.findall(template[at : m.start() if m else len(template)].lower().encode()):
                if opened:
                    optional.add(len(self.steps))
                self.steps.append((w, 1))
            if m is None:
                break
            at = m.end()
            if m[1] == "beginOptional":
                opened.append(len(self.steps))
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError("an optional region ends that did not begin")
                jumps.setdefault(opened.pop(), []).append(len(self.steps))
            else:
                optional.add(len(self.steps))
                most = re.search(r"max=(\d+)", m[1])
                self.steps.append((None, int(most[1]) if most else 40))
        if opened:
            raise ValueError("an optional region doesn't end")
        self.end = len(self.steps)
        self.reach = [self._closure(i, jumps) for i in range(self.end + 1)]
        mandatory = [w for i, (w, _) in enumerate(self.steps) if i not in optional]
        if not mandatory:
            raise ValueError("a template needs a mandatory word")
        self.anchor = max(mandatory, key=len)
        self.first = {self.steps[i][0] for i in self.reach[0] if i < self.end}
        if None in self.first:
            raise ValueError("a template can't begin with a replaceable region")

    def _closure(self, i: int, jumps: dict[int, list[int]]) -> frozenset[int]:
        found, new = {i}, [i]
        while new:
            s = new.pop()
            after = list(jumps.get(s, ()))
            if s < self.end and self.steps[s][0] is None:
                after.append(s + 1)  # a replaceable region may be empty
            for t in after:
                if t not in found:
                    found.add(t)
                    new.append(t)
        return frozenset(found)

    def accepts(self, words: list[bytes], start: int) -> int:
        """The word behind the shortest accepted stretch from ``start``, or -1."""
        live = {(s, 0) for s in self.reach[0]}
        for at in range(start, len(words) + 1):
            if any(s == self.end for s, _ in live):
                return at
            if at == len(words):
                return -1
            word, then = words[at], set()
            for s, used in live:
                expected, most = self.steps[s]
                if expected is None:
                    if used < most:
                        then.add((s, used + 1))
                        then.update((t, 0) for t in self.reach[s + 1])
                elif expected == word:
                    then.update((t, 0) for t in self.reach[s + 1])
            if not then:
                return -1
            live = then
        return -1


#: Wording by label, or pairs of label and wording, where a label may have several.
Templates = dict[str, str] | tuple[tuple[str, str], ...]


class Scanner:
    """All templates and phrases, ready for texts. The default knows ``all_templates``."""

    def __init__(self, templates: Templates | None = None, phrases: dict[str, str] | None = None):
        given = all_templates() if templates is None else templates
        self.automata = [(label, Automaton(t)) for label, t in (given.items() if isinstance(given, dict) else given)]
        self.phrases = [(p.encode().split(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.starts: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, a in self.automata:
            for w in a.first:
                self.starts.setdefault(w, []).append((label, a))
        self.anchors = {max(words, key=len) for words, _ in self.phrases} | {a.anchor for _, a in self.automata}

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Number of words; places of phrases; accepted stretches of templates (first word, word behind, label)."""
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return count_words(low), [], []
        words = LETTERED.findall(low)
        there = set(words)
        phrases, accepted = [], []
        for phrase, label in self.phrases:
            if there.issuperset(phrase):
                phrases += [(i, label) for i in places(words, phrase[0]) if words[i : i + len(phrase)] == phrase]
        for first, automata in self.starts.items():
            usable = [(label, a) for label, a in automata if a.anchor in there] if first in there else []
            for i in places(words, first) if usable else ():
                for label, a in usable:
                    if (stop := a.accepts(words, i)) >= 0:
                        accepted.append((i, stop, label))
        # Of identifiers that begin each other the longest is meant.
        longest = {}
        for i, stop, label in accepted:
            if label.startswith(_TAG):
                longest[i] = max(longest.get(i, 0), stop)
        return len(words), sorted(phrases), sorted({x for x in accepted if not x[2].startswith(_TAG) or longest[x[0]] == x[1]})


def places(words: list[bytes], word: bytes):
    at = -1
    while True:
        try:
            at = words.index(word, at + 1)
        except ValueError:
            return
        yield at


_IN_WORD = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])


def count_words(low: bytes) -> int:
    inside = _IN_WORD[np.frombuffer(low, np.uint8)]
    return int((inside[1:] & ~inside[:-1]).sum() + inside[0]) if len(inside) else 0


@functools.lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...] | None = None) -> Scanner:
    """Once per worker process and set of templates."""
    return Scanner(templates)


def scanned(docs: DataFrame, text: str = "text", templates: Templates | None = None) -> DataFrame:
    """``doc_id, n_words, phrases, templates``: every phrase and every accepted stretch with its place in words.

    ``templates`` takes the place of the known ones; ``doc_id`` may be of any type.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    given = tuple(templates.items()) if isinstance(templates, dict) else templates if templates is None else tuple(map(tuple, templates))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        n, phrases, found = zip(*map(scanner(given).scan, raw_texts(b)), strict=True)
        return batch_of(
            schema, b.column("doc_id"), list(n), [[{"word": i, "label": s} for i, s in p] for p in phrases],
            [[{"word": i, "stop": j, "label": s} for i, j, s in f] for f in found],
        )

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([
        ("doc_id", to_arrow_type(kind)), ("n_words", pa.int64()), ("phrases", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("templates", pa.list_(pa.struct([("word", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))),
    ])
    ddl = f"doc_id {kind.simpleString()}, n_words long, phrases array<struct<word:long,label:string>>, templates array<struct<word:long,stop:long,label:string>>"
    return map_slices(docs.select("doc_id", F.col(text).alias("text")), fn, ddl)


def op6_template_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score: 1 if a template accepts, 0.5 if only a phrase was found, else 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base, more = F.col("phrases.label"), F.col("templates.label")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.word").alias("first_word"),
        F.array_max("phrases.word").alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("templates") > 0, 1.0).when(F.size("phrases") > 0, 0.5).otherwise(0.0).alias("score"),
    )
