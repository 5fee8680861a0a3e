"""Facts read from the normal form of a page: metadata, links, media, main content, dense text.

Every function takes the output of ``markup.canon``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.binding import let
from pagemill.functions.markup import (
    BLOCK_TAGS, SKIP_TAGS, TAG, TAIL, attribute, drop_regions, element_inner, inline_text, names, none_if_empty, re_sub, tags_of,
)

# Places where main content is usually found, tried in this order.
DEFAULT_SELECTORS = (
    "#content", "div#content", "article", "main", '[role="main"]', ".article-content", ".post-content",
    ".detail-content", ".content", ".main-content", "#main-content", ".entry-content", "#main", ".main", ".post",
)
DEFAULT_SELECTOR = ", ".join(DEFAULT_SELECTORS)
DEFAULT_DENSITY = 0.40

_END = r"(?=[\s/>])"


# --- metadata -------------------------------------------------------------------------------

def title(c: Column) -> Column:
    return none_if_empty(inline_text(element_inner(c, "title")))


def meta_content(c: Column, *wanted: str) -> Column:
    """``content`` of the first meta tag whose name or property is one of ``wanted``."""
    maybe = lambda t: F.rlike(t, F.lit("(?i)" + names(re.escape(w) for w in wanted)))
    either = lambda t: maybe(t) & F.lower(F.coalesce(attribute(t, "name", False), attribute(t, "property", False))).isin(*wanted)
    hit = F.get(F.filter(tags_of(c, "meta"), either), F.lit(0))
    return none_if_empty(F.trim(attribute(hit, "content")))


def language(c: Column) -> Column:
    return none_if_empty(attribute(F.get(tags_of(c, "html"), F.lit(0)), "lang"))


def keywords(c: Column) -> Column:
    parts = F.transform(F.split(meta_content(c, "keywords"), "[,，;；、]"), lambda v: F.trim(v))
    return F.coalesce(F.filter(parts, lambda k: k != ""), F.array().cast("array<string>"))


def metadata(c: Column) -> Column:
    return F.struct(
        title(c).alias("title"),
        meta_content(c, "description", "og:description").alias("description"),
        language(c).alias("language"),
        keywords(c).alias("keywords"),
    )


# --- links and media ------------------------------------------------------------------------

def anchors(c: Column) -> Column:
    """Array of (href, text) in page order; anchors without href are left out."""
    pattern = rf"(?is){TAG}<a{_END}{TAIL}.*?(?={TAG}</?a{_END}|\z)"
    split_tag = rf"(?is)^({TAG}<a{_END}{TAIL})"
    return F.filter(
        F.transform(
            F.regexp_extract_all(c, F.lit(pattern), F.lit(0)),
            lambda a: F.struct(
                F.trim(attribute(F.regexp_extract(a, split_tag, 1), "href")).alias("href"),
                inline_text(re_sub(a, split_tag, "")).alias("text"),
            ),
        ),
        lambda s: s["href"].isNotNull(),
    )


def link_kind(page_url: Column, absolute: Column) -> Column:
    """internal or external by host; 'other' for mailto and the like."""
    return (
        F.when(~F.rlike(absolute, F.lit("(?i)^https?://")), F.lit("other"))
        .when(urls.host(absolute) == urls.host(page_url), F.lit("internal"))
        .otherwise(F.lit("external"))
    )


def _sources(c: Column, tag: str) -> Column:
    return F.transform(
        tags_of(c, tag),
        lambda t: F.struct(attribute(t, "src").alias("src"), attribute(t, "alt").alias("alt")),
    )


def images(c: Column) -> Column:
    return _sources(c, "img")


def _players(c: Column, tag: str) -> Column:
    """src of each player tag and of the source tags inside it."""
    whole = F.regexp_extract_all(c, F.lit(rf"(?is){TAG}<{tag}{_END}{TAIL}.*?(?={TAG}</?{tag}{_END}|\z)"), F.lit(0))
    per_tag = F.transform(whole, lambda w: F.transform(tags_of(w, tag, "source"), lambda t: attribute(t, "src")))
    return F.filter(F.flatten(per_tag), lambda s: s.isNotNull())


def videos(c: Column) -> Column:
    return _players(c, "video")


def audios(c: Column) -> Column:
    return _players(c, "audio")


# --- main content by selector ---------------------------------------------------------------

def content_selector(css_selector: Column, selector: Column) -> Column:
    """Selector to use and why: the override, the task's own, or the default list. The three reasons."""
    own = lambda c: c.isNotNull() & (c != "")
    return F.struct(
        F.when(own(css_selector), css_selector)
        .when(own(selector), selector)
        .otherwise(F.lit(DEFAULT_SELECTOR))
        .alias("selector"),
        F.when(own(css_selector), F.lit("css_selector (backward compatibility/override)"))
        .when(own(selector), F.lit("user-provided content_selector"))
        .otherwise(F.lit("heuristic with prioritized default candidates"))
        .alias("reason"),
    )


_COMPOUND = r"""(?:[a-zA-Z][\w-]*+|\*)?(?:[.#][\w-]++|\[[\w-]++(?:=(?:"[^"\]]*+"|'[^'\]]*+'|[\w-]++))?\])*+"""
_MEMBER = rf"^(?!\s*$){_COMPOUND}(?:\s+{_COMPOUND})*$"


def selector_supported(selector: Column) -> Column:
    """True when every member of the comma list is made of tag, .class, #id and [attr], with blanks for descendants."""
    parts = F.transform(F.split(selector, ","), lambda v: F.trim(v))
    return F.forall(parts, lambda p: F.rlike(p, F.lit(_MEMBER)))


def _start_tag_pattern(simple: Column) -> Column:
    """Regular expression for start tags that match one simple selector."""
    tag = F.regexp_extract(simple, r"^([a-zA-Z][\w-]*)", 1)
    conditions = F.regexp_extract_all(simple, F.lit(r"([.#][\w-]+|\[[^\]]+\])"), F.lit(0))

    def look(cond: Column) -> Column:
        key = F.regexp_extract(cond, r"^\[([\w-]+)", 1)
        value = F.regexp_extract(cond, r"""=["']?([^"'\]]*)""", 1)
        word = F.substr(cond, F.lit(2))
        lead = r"(?=[^>]*?\s"
        return (
            F.when(
                F.startswith(cond, F.lit(".")),
                F.concat(F.lit(lead + r"""(?i:class)\s*=\s*["']?(?:[^"'>]*\s)?"""), word, F.lit(r"""["'\s/>])""")),
            )
            .when(
                F.startswith(cond, F.lit("#")),
                F.concat(F.lit(lead + r"""(?i:id)\s*=\s*["']?"""), word, F.lit(r"""["'\s/>])""")),
            )
            .when(~F.contains(cond, F.lit("=")), F.concat(F.lit(lead + "(?i:"), key, F.lit(r")[\s=/>])")))
            .otherwise(
                F.concat(
                    F.lit(lead + "(?i:"), key, F.lit(r""")\s*=\s*["']?\Q"""), value, F.lit(r"""\E["'\s/>])""")
                )
            )
        )

    return F.concat(
        F.lit(f"{TAG}<(?i:"),
        F.when(tag == "", F.lit(r"[a-zA-Z][^\s/>]*")).otherwise(tag),
        F.lit(f"){_END}"),
        F.array_join(F.transform(conditions, look), ""),
    )


def element_at(c: Column, at: Column) -> Column:
    """The element whose start tag begins at position ``at``, up to its balanced end tag, or to the end without one.

    One scan: the rest of the page is split before every tag of the element's name, and a running sum of +1 and -1
    over the pieces ends where it comes back to zero.
    """

    def cut(tail: Column) -> Column:
        name = F.regexp_extract(tail, rf"^{TAG}<([a-zA-Z][^\s/>\\]*)", 1)
        pieces = F.split(tail, F.concat(F.lit(rf"(?i)(?={TAG}</?\Q"), name, F.lit(rf"\E{_END})")))
        ends_tag, empty = rf"^{TAG}</[a-zA-Z]{TAIL}", rf"^{TAG}<[a-zA-Z]{TAIL}(?<=/>)"

        def step(acc: Column, piece: Column) -> Column:
            ends = F.startswith(piece, F.lit(f"{TAG}</"))
            last = ends & (acc["depth"] == 1)
            depth = F.when(ends, acc["depth"] - 1).when((acc["depth"] > 0) & F.rlike(piece, F.lit(empty)), acc["depth"]).otherwise(acc["depth"] + 1)
            size = F.when(last, F.length(F.regexp_extract(piece, ends_tag, 0))).otherwise(F.length(piece))
            return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["size"] + size).alias("size"), last.alias("done")))

        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))
        return F.substr(tail, F.lit(1), F.aggregate(pieces, start, step)["size"])

    return let(F.substr(c, at), cut)


def inside(element: Column) -> Column:
    """An element without its own start tag."""
    return re_sub(element, f"^{TAG}<[a-zA-Z]{TAIL}", "")


def first_element(c: Column, pattern: Column) -> Column:
    """First element whose start tag matches a pattern; NULL without one."""
    return let(F.regexp_instr(c, pattern), lambda at: F.when(at > 0, element_at(c, at)))


def _outermost(c: Column, pattern: Column) -> Column:
    """The matching elements that lie in no other match, in page order."""

    def step(acc: Column, _: Column) -> Column:
        def take(at: Column) -> Column:
            found = let(element_at(acc["rest"], at), lambda e: F.struct(
                F.substr(acc["rest"], at + F.length(e)).alias("rest"), F.concat(acc["found"], F.array(e)).alias("found")
            ))
            return F.when(at > 0, found).otherwise(acc)

        return let(F.regexp_instr(acc["rest"], pattern), take)

    start = F.struct(c.alias("rest"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(F.array_repeat(F.lit(0), F.regexp_count(c, pattern)), start, step)["found"]


def _first_match(c: Column, member: Column) -> Column:
    """First element for one member of a selector list: a compound, or a chain of descendants.

    What a descendant chain finds inside a match it also finds inside the outermost one, so the elements of a step
    never overlap.
    """

    def pick(chain: Column) -> Column:
        last = _start_tag_pattern(F.element_at(chain, -1))
        around = F.aggregate(
            F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 2, F.lit(0))),
            _outermost(c, _start_tag_pattern(F.get(chain, F.lit(0)))),
            lambda found, step: F.flatten(F.transform(found, lambda e: _outermost(inside(e), _start_tag_pattern(step)))),
        )
        nested = F.aggregate(around, F.lit(None).cast("string"), lambda acc, e: F.coalesce(acc, first_element(inside(e), last)))
        return F.when(F.size(chain) == 1, first_element(c, last)).when(F.regexp_instr(c, last) > 0, nested)

    return let(F.regexp_extract_all(member, F.lit(r"((?:[^\s\[]|\[[^\]]*\])+)"), F.lit(1)), pick)


def _default_pattern(member: str) -> str:
    """Pattern of one default selector (tag, #id, .class, [attr="value"]) as a literal, compiled once for all pages."""
    tag, rest = re.fullmatch(r"([a-z]*)(.*)", member).groups()
    look = r"(?=[^>]*?\s"
    if rest[:1] == "#":
        look += rf"""(?i:id)\s*=\s*["']?{rest[1:]}["'\s/>])"""
    elif rest[:1] == ".":
        look += rf"""(?i:class)\s*=\s*["']?(?:[^"'>]*\s)?{rest[1:]}["'\s/>])"""
    elif rest:
        key, value = re.fullmatch(r'\[(\w+)="(\w+)"\]', rest).groups()
        look += rf"""(?i:{key})\s*=\s*["']?{value}["'\s/>])"""
    return rf"{TAG}<(?i:{tag or r'[a-zA-Z][^\s/>]*'}){_END}" + (look if rest else "")


def select_default(c: Column) -> Column:
    """First element for the default selectors, tried in order; NULL when none matches."""
    return F.coalesce(*(first_element(c, F.lit(_default_pattern(m))) for m in DEFAULT_SELECTORS))


def select_content(c: Column, selector: Column) -> Column:
    """First element that matches the selector list, members tried in order; NULL when none does.

    Unsupported members are skipped; ``unsupported`` names them.
    """
    members = F.filter(F.transform(F.split(selector, ","), lambda v: F.trim(v)), lambda p: F.rlike(p, F.lit(_MEMBER)))
    own = F.aggregate(
        members, F.lit(None).cast("string"), lambda acc, member: F.coalesce(acc, _first_match(c, member))
    )
    return F.when(selector == DEFAULT_SELECTOR, select_default(c)).otherwise(own)


def unsupported(selector: Column) -> Column:
    """Members of the selector list that ``select_content`` skips, comma-joined; NULL when there are none."""
    parts = F.transform(F.split(selector, ","), lambda v: F.trim(v))
    return none_if_empty(F.array_join(F.filter(parts, lambda p: ~F.rlike(p, F.lit(_MEMBER))), ", "))


# --- density pruning ------------------------------------------------------------------------

def text_blocks(c: Column) -> Column:
    """Blocks of a page between block tags, each with its text, markup and link sizes.

    Skip regions and the head are left out, so are blocks without text.
    """
    base = drop_regions(c, (*SKIP_TAGS, "head"))
    pieces = F.split(base, rf"(?i){TAG}</?{names(BLOCK_TAGS)}{_END}{TAIL}")
    link = F.lit(rf"(?is){TAG}<a{_END}{TAIL}(.*?)(?={TAG}</?a{_END}|\z)")

    def measure(p: Column) -> Column:
        return F.struct(
            p.alias("html"),
            inline_text(p).alias("text"),
            F.length(re_sub(p, f"{TAG}|^\\s++|(?<!\\s)\\s++$", "")).alias("markup_chars"),
            F.when(
                F.contains(p, F.lit(f"{TAG}<a")),
                F.length(inline_text(F.array_join(F.regexp_extract_all(p, link, F.lit(1)), " "))),
            ).otherwise(F.lit(0)).alias("link_chars"),
        )

    return F.filter(F.transform(pieces, measure), lambda b: b["text"] != "")


def keep_block(block: Column, threshold: Column) -> Column:
    """Shallow-text test: text share of the markup times the share of text outside links.

    The threshold adapts to the block (0.8 of it for blocks of 200 characters or more, 1.2 of it
    when links make up over half of the text). Raising the threshold never adds a block.
    """
    text = F.length(block["text"])
    density = text / F.greatest(block["markup_chars"], text)
    link_share = F.least(block["link_chars"], text) / text
    factor = F.when(link_share > 0.5, 1.2).when(text >= 200, 0.8).otherwise(1.0)
    return density * (1 - link_share) >= threshold * factor


def effective_threshold(threshold: Column) -> Column:
    """A missing or zero threshold means the default."""
    return F.when(threshold.isNull() | (threshold == 0), F.lit(DEFAULT_DENSITY)).otherwise(threshold)


def dense_text(c: Column, threshold: Column) -> Column:
    """Text of the blocks that pass ``keep_block``, one per line; NULL when none does."""
    t = effective_threshold(threshold)
    kept = F.filter(text_blocks(c), lambda b: keep_block(b, t))
    return none_if_empty(F.array_join(F.transform(kept, lambda b: b["text"]), "\n"))


def dense_versions(c: Column, threshold: Column) -> Column:
    """Dense text and the markup it came from, as struct<fit, fit_html>."""
    t = effective_threshold(threshold)
    return let(
        F.filter(text_blocks(c), lambda b: keep_block(b, t)),
        lambda kept: F.struct(
            none_if_empty(F.array_join(F.transform(kept, lambda b: b["text"]), "\n")).alias("fit"),
            none_if_empty(
                re_sub(F.array_join(F.transform(kept, lambda b: b["html"]), "\n"), TAG, "")
            ).alias("fit_html"),
        ),
    )
