"""Decoding of HTML character references as a Column expression.

The text is cut into references and the runs between them in one left-to-right scan, so
``&amp;lt;`` becomes ``&lt;`` and is never decoded twice. Text that holds only the frequent
references takes a chain of literal replacements instead, ``&amp;`` last, which gives the same.
"""

from __future__ import annotations

import functools
from html.entities import html5, name2codepoint

from pyspark.sql import Column

from pagemill.functions.binding import let, quoted, sql_let

_REF = r"&(?:#[xX][0-9a-fA-F]++|#[0-9]++|[a-zA-Z][a-zA-Z0-9]*+);?+"
_TOKEN = _REF + r"|[^&]++|&"

# References so common that they are tested before the full table; "amp" is last
# so that a replaced ampersand never starts a new reference.
_FREQUENT = ("lt", "gt", "quot", "nbsp", "apos", "copy", "middot", "mdash", "ndash", "hellip", "amp")

_REF_BUT = "&(?!(?:{});)[#a-zA-Z]"


_KEY, _VALUE = "\ufdd4", "\ufdd5"


@functools.cache
def _table(full: bool) -> str:
    """Named references in one string, which keeps the plan small: key mark, name, value mark, text.

    The short table has the HTML 4 names only, the full one everything HTML 5 lists.
    """
    names = {k: v for k, v in html5.items() if full or k.rstrip(";") in name2codepoint}
    return "".join(f"{_KEY}{k}{_VALUE}{v}" for k, v in names.items()) + _KEY


def _lookup(name: str, full: bool) -> str:
    """Text of a named reference, NULL when there is none."""
    table = quoted(_table(full))
    key = f"concat({quoted(_KEY)}, {name}, {quoted(_VALUE)})"
    found = f"substring_index(substr({table}, at + length({name}) + 2), {quoted(_KEY)}, 1)"
    return sql_let("at", f"instr({table}, {key})", f"CASE WHEN at > 0 THEN {found} END")


@functools.cache
def _legacy_names() -> list[str]:
    """Names that are valid without the semicolon, longest first."""
    return sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


@functools.cache
def _cp1252_row() -> str:
    """What numeric references 0x80..0x9f stand for (bytes without a mapping stay as they are)."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def _code_point(digits: str) -> str:
    """Character of a numeric reference; ``digits`` is SQL for the code point or NULL."""
    return sql_let("cp", digits, f"""CASE
        WHEN cp IS NULL OR cp = 0 OR cp > 1114111 OR cp BETWEEN 55296 AND 57343 THEN {quoted(chr(0xFFFD))}
        WHEN cp = 13 THEN {quoted(chr(13))}
        WHEN cp BETWEEN 128 AND 159 THEN substring({quoted(_cp1252_row())}, CAST(cp - 127 AS INT), 1)
        WHEN cp BETWEEN 1 AND 8 OR cp = 11 OR cp BETWEEN 14 AND 31 OR cp = 127 OR cp BETWEEN 64976 AND 65007
             OR (cp & 65534) = 65534 THEN ''
        ELSE decode(unhex(lpad(hex(cp), 8, '0')), 'UTF-32') END""")


def _numeric(tok: str) -> str:
    digits = f"regexp_extract({tok}, '^&#[xX]?0*([0-9a-fA-F]*)', 1)"
    value = f"""CASE WHEN length(d) > 9 THEN 2147483647L
        WHEN lower(substring({tok}, 3, 1)) = 'x' THEN CAST(conv(concat('0', d), 16, 10) AS BIGINT)
        ELSE try_cast(concat('0', d) AS BIGINT) END"""
    return sql_let("d", digits, _code_point(value))


def _named(tok: str, full: bool) -> str:
    """A named reference; without semicolon the longest legacy name at its start counts."""
    whole = f"substr({tok}, 2)"
    if not full:
        return f"coalesce({_lookup(whole, full)}, {tok})"
    legacy = f"regexp_extract({tok}, {quoted('^&(' + '|'.join(_legacy_names()) + ')')}, 1)"
    prefix = sql_let("p", legacy, f"CASE WHEN p = '' THEN {tok} ELSE concat({_lookup('p', full)}, substr({tok}, length(p) + 2)) END")
    return f"coalesce(CASE WHEN endswith({tok}, ';') THEN {_lookup(whole, full)} END, {prefix})"


def _replace_each(text: str, wanted) -> str:
    for n in wanted:
        text = f"regexp_replace({text}, '&{n};', {quoted(html5[n + ';'])})"
    return text


@functools.cache
def _decode(full: bool) -> str:
    """SQL over ``v``."""
    token = f"""CASE WHEN NOT startswith(k, '&') OR length(k) < 3 THEN k
        WHEN substring(k, 2, 1) = '#' THEN {_numeric("k")} ELSE {_named("k", full)} END"""
    return f"""CASE WHEN NOT contains(v, '&') THEN v
        WHEN NOT rlike(v, {quoted(_REF_BUT.format("amp"))}) THEN {_replace_each("v", ("amp",))}
        WHEN NOT rlike(v, {quoted(_REF_BUT.format("|".join(_FREQUENT)))}) THEN {_replace_each("v", _FREQUENT)}
        ELSE array_join(transform(regexp_extract_all(v, {quoted(_TOKEN)}, 0), k -> {token}), '') END"""


def decode_entities(text: Column, full: bool = False) -> Column:
    """Replace named, legacy (without semicolon) and numeric character references.

    ``full`` knows all HTML 5 names; it is meant for body text, since its table travels in the
    plan with every use. Titles, link texts and attribute values know the HTML 4 names.
    """
    return let(text, _decode(full))
