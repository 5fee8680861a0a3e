import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int = 80) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "er", "ing", "tion", "s"]) for _ in range(n))


ITEM = "the seven old clocks on the north wall stopped at noon when nobody was there to hear them"

#: Id, text, and columns whose names the operators use themselves.
ROWS = [
    (1, prose(1), "a"), (2, prose(1), "b"), (3, prose(1) + " more", "c"), (4, None, "d"), (5, "", "e"), (6, " \t\n", "f"),
    (7, prose(7) + " " + ITEM + " " + prose(8), "g"), (7, prose(7) + " " + ITEM + " " + prose(8), "g"), (8, "x", None), (None, "y z", "h"),
    (None, None, None), (9, "word " * 30_000, "i"), (10, "é世🙂 ünï <|endoftext|> don't STOP 12345", "j"), (11, prose(11) + " idiot moron scum trash idiot", "k"),
    (12, "Licensed under the Apache License, Version 2.0. mail a.b@c.org or 10.0.0.1, +1 (212) 555-0000; token = \"0123456789abcdef0123456789abcdef\"", "l"),
    (13, "#### " * 60, "m"), (14, "same line\nsame line\nsame line\nother", "n"), (15, "1" * 50_000, "o"),
]

#: Pages with URLs of all kinds, and columns whose names the operators use themselves.
PAGES = [
    (i, url, "<p>x</p>", "h", 1)
    for i, url in enumerate([
        None, "", "no scheme", "://", "http://", "HTTP://Example.NET:80", "http://a.net?x=/", "http://A.Net/#x", "x://y://z/fr/", "http://u:p@WWW.Casino.org:443/a//?b=1&a=2&utm_source=x#f",
        "https://casino.org/a?a=2&b=1", "https://casino.org/a?a=2", "http://example.com/de/" + "a" * 100_000, "http://notexample.com/de/", "http://org/fr/?", "http://x.org/fr", "http://en.example.net/en/x",
        "http://en.example.net/EN/x", "ftp://poker.example.org/ü?é#ß", "ftp://poker.example.org/ü?é#ß", "https://poker.example.org/ü/?é&ref=1", "http://net/", "http://fr.example.net/fr/", "http://pokery.example.org/",
    ])
] + [(None, "http://spam.example.org/fr/", None, None, None), (3, "http://spam.example.org/en", None, None, None)]


@pytest.fixture(scope="session")
def made(spark, tmp_path_factory):
    """A folder of small tables: hard rows, and none at all."""
    top = tmp_path_factory.mktemp("tables")
    wide = "doc_id long, text string, spans string"
    docs = spark.createDataFrame(ROWS, wide)
    for name, rows in (("hard", docs), ("none", docs.limit(0))):
        rows.selectExpr("*", "'w' as n_words", "1.5d as fp", "array(1) as items", "'q' as p_toxic", "'r' as redacted", "if(doc_id % 3 = 0, null, 'en') as lang").coalesce(2).write.parquet(f"{top}/{name}/documents.parquet")
        labels = [(i, int(i != 13), int(i == 11)) for i in range(1, 16)] + [(None, 1, 0), (3, None, None)]
        spark.createDataFrame(labels if name == "hard" else [], "doc_id long, quality int, toxic int").write.parquet(f"{top}/{name}/labels.parquet")
        items = [(1, ITEM), (2, None), (None, ITEM), (3, "x"), (3, "x"), (4, "?!"), (5, "never there at all")]
        spark.createDataFrame(items if name == "hard" else [], "item_id long, text string").write.parquet(f"{top}/{name}/benchmark.parquet")
        spark.createDataFrame(PAGES if name == "hard" else [], "page_id long, url string, html string, host string, __salt int").write.parquet(f"{top}/{name}/pages.parquet")
    return str(top)


@pytest.fixture
def hard(made):
    return f"{made}/hard"


@pytest.fixture
def none(made):
    return f"{made}/none"
