"""SQL fragments for the check queries on page tables.

They state the same results by other means (one replacement per tag, no markers, no nesting),
which is enough for the given pages.
"""

from __future__ import annotations

SEP, NL = "chr(1)", "chr(2)"
BLOCKS = "p|div|section|article|br|hr|li|ul|ol|h1|h2|h3|h4|h5|h6|table|tr|td"


def rx(expr: str, pattern: str, repl: str, flags: str = "g") -> str:
    p = pattern.replace("'", "''")
    return f"regexp_replace({expr}, '{p}', {repl}, '{flags}')"


def without(expr: str, *tags: str) -> str:
    """Drop comments and whole elements."""
    s = rx(expr, "<!--.*?-->", SEP, "gs")
    for t in tags:
        s = rx(s, rf"<{t}(\s[^>]*)?>.*?</{t}\s*>", SEP, "gsi")
    return s


def decoded(expr: str) -> str:
    s = expr
    for name, ch in (("quot", "chr(34)"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("lt", "'<'"), ("gt", "'>'"), ("nbsp", "chr(160)")):
        s = f"replace({s}, '&{name};', {ch})"
    return rx(s, "&amp;?", "'&'")


def cut_tail(expr: str) -> str:
    return rx(expr, r"<[/a-zA-Z][^>]*$", "''")


def to_text(expr: str) -> str:
    s = cut_tail(expr)
    s = rx(s, rf"</?({BLOCKS})(\s[^>]*)?>", NL, "gi")
    s = decoded(rx(s, r"<[!/a-zA-Z][^>]*>", SEP))
    s = f"replace(replace({s}, {SEP}, ' '), {NL}, ' ' || chr(10) || ' ')"
    s = rx(s, r"[ \t]{2,}", "' '")
    s = rx(s, r"\n\s*\n\s*\n+", "chr(10) || chr(10)")
    return f"nullif(trim({s}, ' ' || chr(10) || chr(9) || chr(13)), '')"


def inline(expr: str) -> str:
    s = decoded(rx(expr, r"<[!/a-zA-Z][^>]*>|\x01", "' '"))
    return f"trim({rx(s, r'\s+', repr(' '))})"


CLEAN_TAGS = ("script", "style", "nav", "header", "footer", "aside")
CLEAN = to_text(without("html", *CLEAN_TAGS))
RAW = to_text(without("html", "script", "style"))
HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"

# Blocks of the page body with their sizes, and the keep test at the default threshold.
DENSE = f"""
blocks AS (
  SELECT page_id, url, i, p FROM (
    SELECT page_id, url, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
      SELECT page_id, url, string_split_regex({cut_tail(without("html", *CLEAN_TAGS, "head"))},
             '(?i)</?({BLOCKS})(\\s[^>]*)?>') AS ps FROM pages))),
measured AS (
  SELECT page_id, url, i, p, {inline("p")} AS txt,
         length({rx("replace(p, chr(1), '')", r"^\s+|\s+$", "''")}) AS markup_chars,
         CASE WHEN contains(p, '<a ') THEN
           length({inline("array_to_string(regexp_extract_all(p, '(?s)<a\\s[^>]*>(.*?)</a>', 1), ' ')")}) ELSE 0 END AS link_chars
  FROM blocks),
scored AS (
  SELECT *, length(txt) / greatest(markup_chars, length(txt)) AS density, least(link_chars, length(txt)) / length(txt) AS link_share
  FROM measured WHERE txt <> ''),
dense AS (
  SELECT page_id, string_agg(txt, chr(10) ORDER BY i) AS fit, count(*) AS blocks FROM scored
  WHERE density * (1 - link_share) >= 0.40 * CASE WHEN link_share > 0.5 THEN 1.2 WHEN length(txt) >= 200 THEN 0.8 ELSE 1.0 END
  GROUP BY page_id)"""
