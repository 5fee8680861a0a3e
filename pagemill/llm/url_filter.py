"""Verdicts on URLs: rules by host and path, then a list of URLs behind a blocked Bloom filter and an exact hash join.

A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins. URLs without a rule
are looked up in a list of canonical URLs. A Bloom filter of the list, in blocks of 256 bits that hold all bits of an
entry, lets only possible hits through; these meet the list in a hash join on the whole canonical URL, which removes the
false positives. So pages that aren't listed are never shuffled.

The filter has 16 bits an entry, at most ``MOST_BYTES``: its parts are made by Spark tasks and only its bits reach the
driver. A list too long for that makes the filter denser: more rows go to the join, and the verdicts stay exact.
A listed URL that a third of all pages share is looked up once and handed back to its rows by salts.

Canonical: scheme, user, default ports, a leading ``www.``, trailing slashes, fragment and tracking parameters are
dropped, host letters A-Z are lower-cased, other parameters sorted. Texts are compared as they are otherwise.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed, since it has no
canonical form; a URL without a path fits no rule with one; null, repeated and non-canonical list entries are
canonicalised and count once; an empty list blocks nothing; an empty table gives an empty result; repeated rows each get
their verdict; very long URLs are taken whole; names that the table already has get underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow, free_names, ship, stored, table

#: Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bits an entry, words of 32 bits in a block, blocks in a part (a megabyte), and the whole filter's largest size.
ENTRY_BITS, WORDS, PART, MOST_BYTES = 16, 8, 1 << 15, 64 << 20
#: Parts that the rows of a hot URL are dealt to in the join back.
SALTS = 16
#: Parameters that only say where a visitor came from.
TRACKING = r"^(?:utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|igshid|ref)(?:=|$)"
#: Words of host names that unwanted sites go by; a host has one if a part of it between dots and hyphens is one.
UNWANTED = (
    "ad", "ads", "adserver", "adult", "affiliate", "banner", "banners", "bet", "bets", "betting", "bingo", "bonus", "camgirls", "casino",
    "casinos", "cheap", "clicks", "crack", "cracks", "dating", "doubleclick", "escort", "escorts", "gambling", "hookup", "jackpot",
    "keygen", "loans", "lottery", "nude", "payday", "pharmacy", "phishing", "pills", "poker", "popup", "popups", "porn", "replica",
    "roulette", "scam", "serials", "sex", "slots", "spam", "spyware", "torrents", "tracker", "viagra", "warez", "webcam", "xxx",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_SALT = np.random.default_rng(13).integers(1, 1 << 32, WORDS, dtype=np.uint64) | np.uint64(1)


def _part(url: Column, n: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, n), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """The form that listed URLs are compared in; null without ``://``."""
    site = F.regexp_replace(host(url), r"^[^@]*@|(?::(?:80|443)?)$", "")
    given = F.filter(F.split(_part(url, 3), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    query = F.array_join(F.array_sort(given), "&")
    whole = F.concat(F.regexp_replace(site, r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.contains(url, F.lit("://")), whole)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that wins and its verdict; null without one. Of rules of one length the one of the longer host wins."""
    if len({(h, p) for _, h, p in rules}) < len(set(rules)):
        raise ValueError("a rule says both allow and block")
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1])):  # the last one asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and the bit it sets in each of the block's words."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits = (((h & np.uint64(0xFFFFFFFF))[:, None] * _SALT) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return block.astype(np.int64), (np.uint32(1) << bits.astype(np.uint32))


def size_of(entries: int, most: int = MOST_BYTES) -> int:
    """Blocks of a filter for so many entries."""
    return max(1, min(-(-entries * ENTRY_BITS // (32 * WORDS)), most // (4 * WORDS)))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """``part, words``: the filter of the hashes ``h`` in parts of at most a megabyte, each made by one task."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, None
        for b in batches:
            of, h = b.column("part").to_numpy(), b.column("h").to_numpy()
            for p in np.unique(of):
                if p != now:
                    if words is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([words.tobytes()])], names=["part", "words"])
                    now, words = int(p), np.zeros((min(PART, blocks - int(p) * PART), WORDS), np.uint32)
                block, bits = places(h[of == p], blocks)
                np.bitwise_or.at(words, block - now * PART, bits)
        if words is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([words.tobytes()])], names=["part", "words"])

    block = F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * F.lit(blocks), 32)
    dealt = keys.select("h", F.floor(block / PART).cast("int").alias("part")).repartition("part").sortWithinPartitions("part")
    return arrow(dealt, fn, "part int, words binary")


def passes(filter_parts: DataFrame, blocks: int):
    """A function of a hash column without nulls: may the entry be listed? The bits (at most ``MOST_BYTES``) go to every executor."""
    words = np.zeros((blocks, WORDS), np.uint32)
    for r in filter_parts.toLocalIterator():  # bounded by MOST_BYTES
        part = np.frombuffer(r["words"], np.uint32).reshape(-1, WORDS)
        words[r["part"] * PART : r["part"] * PART + len(part)] = part
    ship(filter_parts.sparkSession)
    shared = filter_parts.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def may(h: pa.Array) -> pa.Array:
        block, bits = places(h.to_numpy(), blocks)
        return pa.array(((shared.value[block] & bits) == bits).all(axis=1))

    return may


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url", listed_url: str = "url", most_bytes: int = MOST_BYTES) -> tuple[DataFrame, list[str]]:
    """``pages`` with host, path, rule and verdict, and the four columns' names. ``listed``: URLs to block."""
    names = free_names(pages, ["host", "path", "rule", "verdict", "__canonical", "__salt"])
    h, p, rule, verdict, form, salt = names
    entries = stored(listed.select(canonical(F.col(listed_url)).alias(form)).where(F.col(form).isNotNull()).distinct(), "listed-urls")
    blocks = size_of(entries.count(), most_bytes)
    may = passes(stored(bloom(entries.select(F.xxhash64(form).alias("h")), blocks), "url-filter"), blocks)

    parts = pages.withColumns({h: host(F.col(url)), p: path(F.col(url))})
    name, said = rule_of(F.col(h), F.col(p), rules)
    ruled = parts.withColumns({rule: name, verdict: said})
    hashed = ruled.withColumn(form, F.when(F.col(verdict).isNull(), canonical(F.col(url))))
    maybe = hashed.withColumn(salt, may(F.xxhash64(form)) & F.col(form).isNotNull())
    clear = maybe.where(~F.col(salt)).withColumn(verdict, F.coalesce(verdict, F.lit("allow")))

    # The exact join: each possible hit's URL once against the list, then the hits back to their rows by salts.
    possible = maybe.where(F.col(salt))
    hits = stored(possible.select(form).distinct().join(entries.hint("shuffle_hash"), form), "url-hits")
    salted = hits.select(form, F.explode(F.array(*map(F.lit, range(SALTS)))).alias(salt), F.lit("block").alias("__listed"))
    spread = possible.withColumn(salt, F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)).cast("int"))
    found = spread.join(salted.hint("shuffle_hash"), [form, salt], "left").withColumn(verdict, F.coalesce("__listed", F.lit("allow")))
    keep = [*pages.columns, h, p, rule, verdict]
    return clear.select(*keep).unionByName(found.select(*keep)), names[:4]


def unwanted(pages: DataFrame, words=UNWANTED, url: str = "url") -> DataFrame:
    """``url``: the pages' URLs whose host has one of the words between dots and hyphens."""
    return pages.select(F.col(url).alias("url")).where(F.arrays_overlap(F.split(host(F.col("url")), "[.-]"), F.array(*map(F.lit, words))))


def op13_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged; the list is the URLs of pages on unwanted hosts, in whatever form they were fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found, (h, p, rule, verdict) = judged(pages, unwanted(pages))
    return found.select("page_id", F.col(h).alias("host"), F.col(p).alias("path"), F.col(rule).alias("rule"), F.col(verdict).alias("verdict"))


_WORDS_SQL = ", ".join(f"'{w}'" for w in UNWANTED)
OP13_SQL = rf"""
WITH u AS (SELECT page_id, url, contains(coalesce(url, ''), '://') AS ok,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)\?([^#]*)', 3), '') AS query FROM pages),
c AS (SELECT *, CASE WHEN ok THEN regexp_replace(regexp_replace(host, '^[^@]*@|:(80|443)?$', '', 'g'), '^www\.', '') || regexp_replace(path, '/+$', '')
  || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS form FROM (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS q FROM u)),
listed AS (SELECT DISTINCT form FROM c WHERE form IS NOT NULL AND len(list_intersect(string_split_regex(host, '[.-]'), [{_WORDS_SQL}])) > 0),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN form IN (SELECT form FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
