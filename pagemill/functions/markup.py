"""HTML as text columns: one tokenising pass, then plain regular expressions.

``canon`` rewrites a page once so that every genuine tag carries a marker character in
front and comments, scripts, styles and declarations are gone. All later functions work on
that form, so a ``<nav>`` in a comment, a script string or a quoted attribute never counts.
The markers are Unicode noncharacters, which cannot occur in interchanged text; one that does
counts as a gap between two texts.

Nested regions are removed innermost pair first. The number of passes follows the data, so
any nesting depth is exact, while a page without nesting pays for a single pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let, quoted
from pagemill.functions.entities import decode_entities

TAG, OPEN, CLOSE, NL, MID = "﷐", "﷑", "﷒", "﷓", "﷖"
_MARKS = TAG + OPEN + CLOSE + NL + MID

# Regions dropped by cleaning, and tags that end a line.
SKIP_TAGS = ("nav", "header", "footer", "aside", "script", "style")
BLOCK_TAGS = (
    "p", "div", "section", "article", "br", "hr", "li", "ul", "ol",
    "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td",
)

# Whitespace in the Unicode sense, spelled out so that every engine agrees.
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
WS_CHARS = (
    "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]))
    + "    　"
)

# Rest of a tag after its name: a ">" inside a quoted attribute value does not end it.
TAIL = r"""(?:[^>=]++|=[\t\n\r\f ]*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_END = r"(?=[\s/>])"

_CANON = (
    rf"(?is)(?=[<{_MARKS}])(?:[{_MARKS}]"
    r"|<!--.*?(?:--!?>|\z)"
    rf"|<(script|style){_END}{TAIL}(?<!/>).*?(?:</\1{_END}[^>]*+>|\z)"
    r"|<[!?][^>]*+(?:>|\z)"
    r"|</(?![a-zA-Z])[^>]*+(?:>|\z)"
    rf"|<(?:{'|'.join(SKIP_TAGS)}){_END}{TAIL}(?<=/>)"
    rf"|(</?[a-zA-Z]{TAIL}|<(?![/a-zA-Z]))"
    r"|</?[a-zA-Z].*\z)"
)


def none_if_empty(c: Column) -> Column:
    return let(c, lambda v: F.when(v != "", v))


def names(tags) -> str:
    return "(?:" + "|".join(tags) + ")"


def re_sub(c: Column, pattern: str, repl: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(repl))


def canon(html: Column) -> Column:
    """Marked normal form of a page: no comments, scripts, styles, empty skip regions or cut-off last tag."""
    return re_sub(html, _CANON, TAG + "$2")


def _count(c: Column, ch: str) -> Column:
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))) / len(ch)).cast("int")


def _fold(c: Column, pattern: str, repl: str, opened: str, closed: str) -> Column:
    """Rewrite every balanced region, innermost first, until none is left."""
    depth = lambda v: F.when(F.contains(v, F.lit(opened)), F.least(_count(v, opened), _count(v, closed))).otherwise(F.lit(0))
    return let(
        re_sub(c, pattern, repl),
        lambda once: F.aggregate(
            F.array_repeat(F.lit(0), depth(once)), once, lambda acc, _: re_sub(acc, pattern, repl)
        ),
    )


def fold_pairs(c: Column, repl: str) -> Column:
    """Rewrite balanced OPEN..CLOSE regions."""
    return _fold(c, f"{OPEN}([^{OPEN}{CLOSE}]*+){CLOSE}", repl, OPEN, CLOSE)


def drop_regions(c: Column, tags=SKIP_TAGS) -> Column:
    """Remove skip regions from the normal form by a shared depth counter.

    A stray end tag never takes the counter below zero; an unclosed start tag swallows the rest.
    One pass turns the tags into OPEN MID and OPEN / MID.
    """
    start, end = OPEN + MID, OPEN + "/" + MID
    s = re_sub(c, rf"(?i){TAG}<(/?){names(tags)}{_END}{TAIL}", f"{OPEN}$1{MID}")
    s = _fold(s, f"{start}[^{OPEN}]*+{end}", TAG, start, end)
    return let(s, lambda v: F.when(F.contains(v, F.lit(OPEN)), re_sub(v, f"(?s){start}.*\\z|{end}", TAG)).otherwise(v))


def _lines(c: Column) -> Column:
    """Tags to marks: block tags end a line, any other tag separates text."""
    n = names(BLOCK_TAGS)
    s = re_sub(c, rf"(?i){TAG}<{n}{_END}{TAIL}(?<=/>)", NL + NL)
    s = re_sub(s, rf"(?i){TAG}</?{n}{_END}{TAIL}", NL)
    s = re_sub(s, rf"{TAG}</?[a-zA-Z]{TAIL}", TAG)
    lone = f"{TAG}<"
    return let(s, lambda v: F.when(F.contains(v, F.lit(lone)), re_sub(v, lone, lone + TAG)).otherwise(v))


_EDGE = f"[{WS}](?:(?<=[{TAG}{NL}][{WS}])[{WS}]*+|(?<![{WS}][{WS}])[{WS}]*+(?=[{TAG}{NL}]))"
_ODD_SPACE = f"[{WS.replace('-\\x20', '-\\x1f').replace('\\t-', '\\n-')}]"


def to_text(c: Column) -> Column:
    """Visible text of a normal form; NULL when nothing is left.

    Blanks next to a tag vanish in the blank-run pass; only text with other whitespace
    (line breaks, no-break spaces) needs the edge pass.
    """
    s = let(decode_entities(_lines(c), full=True), lambda v: F.when(F.rlike(v, F.lit(_ODD_SPACE)), re_sub(v, _EDGE, "")).otherwise(v))
    s = re_sub(re_sub(s, NL, " \n "), rf"[ \t{TAG}]{{2,}}|{TAG}", " ")
    s = re_sub(s, rf"\n[{WS}]*\n[{WS}]*\n+", "\n\n")
    return none_if_empty(F.btrim(s, F.lit(WS_CHARS)))


def inline_text(c: Column) -> Column:
    """Text of a short fragment on one line."""
    s = decode_entities(re_sub(c, rf"{TAG}</?[a-zA-Z]{TAIL}|{TAG}", " "))
    return F.btrim(re_sub(s, f"[{WS}]+", " "), F.lit(WS_CHARS))


def clean_text(html: Column) -> Column:
    """Main text without navigation, header, footer, aside, script and style regions."""
    return to_text(drop_regions(canon(html)))


def raw_text(html: Column) -> Column:
    """All visible text; only scripts and styles are dropped."""
    return to_text(canon(html))


_ATTR = r"""(?<![^\s"'<>/=])([^\s"'<>/=]++)[\t\n\r\f ]*+=[\t\n\r\f ]*("[^"]*"|'[^']*'|[^\s>"']+)"""


def attribute(tag: Column, name: str, decode: bool = True) -> Column:
    """Value of an attribute of one tag; NULL when absent."""

    pick = lambda group: f"regexp_extract_all(v, {quoted(_ATTR)}, {group})"
    at = f"CAST(array_position(transform({pick(1)}, k -> lower(k)), {quoted(name)}) AS INT) - 1"
    present = let(tag, f"CASE WHEN contains(lower(v), {quoted(name)}) THEN get({pick(2)}, {at}) END")
    bare = re_sub(present, r"""^["']|["']$""", "")
    return decode_entities(bare) if decode else bare


def tags_of(c: Column, *tag_names: str) -> Column:
    """Start tags with one of the names, in page order."""
    return F.regexp_extract_all(c, F.lit(rf"(?i){TAG}<{names(tag_names)}{_END}{TAIL}"), F.lit(0))


def element_inner(c: Column, tag: str) -> Column:
    """Inside of the first element with this name ('' when absent); for elements that do not nest."""
    return F.regexp_extract(c, rf"(?is){TAG}<{tag}{_END}{TAIL}(.*?)(?={TAG}</{tag}{_END}|\z)", 1)
