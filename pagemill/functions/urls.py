"""URL columns: host, file name, relative to absolute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let

# Path endings treated as attachments.
ATTACHMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "7z", "csv", "txt")

_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user info and port; '' when the URL has none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def filename(url: Column) -> Column:
    """Last path segment; a name derived from the URL's hash when the path is empty."""
    last = F.regexp_extract(path(url), r"([^/]*)/*$", 1)
    return let(
        last, lambda v: F.when(v != "", v).otherwise(F.concat(F.lit("resource_"), F.substring(F.sha2(url, 256), 1, 8)))
    )


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))


def _remove_dots(p: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    segments = F.split(F.substr(p, F.lit(2)), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    trailing = F.when(F.rlike(p, F.lit(r"/\.\.?$")), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, trailing).otherwise(F.lit("")))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on the page ``base``."""
    origin = F.regexp_extract(base, _ORIGIN, 1)
    base_path = path(base)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_extract(base_path, r"^(.*/)", 1))
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    no_fragment = F.regexp_extract(base, r"^([^#]*)", 1)

    def joined(p: Column) -> Column:
        clean = let(p, lambda v: F.when(F.rlike(v, F.lit(r"(?:^|/)\.\.?(?:/|$)")), _remove_dots(v)).otherwise(v))
        return F.concat(origin, clean, tail)

    return (
        F.when(F.rlike(ref, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), ref))
        .when(ref == "", no_fragment)
        .when(F.startswith(ref, F.lit("#")), F.concat(no_fragment, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), ref))
        .when(F.startswith(ref, F.lit("/")), joined(F.regexp_extract(ref, r"^([^?#]*)", 1)))
        .otherwise(joined(F.concat(folder, F.regexp_extract(ref, r"^([^?#]*)", 1))))
    )


def is_http(url: Column) -> Column:
    """The accepted URL schemes; the test is case sensitive."""
    return F.rlike(url, F.lit("^https?://"))


def artifact_path(run_date: Column, run_id: Column, kind: str | Column, name: Column) -> Column:
    """``{date}/{run}/{kind}/{name}`` with a date fixed by the caller."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws("/", F.date_format(run_date, "yyyy-MM-dd"), run_id, k, name)
