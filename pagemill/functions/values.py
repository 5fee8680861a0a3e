"""Field clean-up: dates, prices, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let
from pagemill.functions.markup import WS, WS_CHARS, re_sub

# Full-width punctuation and its ASCII form.
FULL_WIDTH = "，。！？：；（）【】“”‘’　"
ASCII_FORM = ",.!?:;()[]\"\"'' "

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NUMERIC_DATE = r"(?<![0-9])([0-9]{4})(?:[-/.]|年)([0-9]{1,2})(?:[-/.]|月)([0-9]{1,2})(?![0-9])"
_MONTH_DAY = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? ([0-9]{1,2}),? ([0-9]{4})"
_DAY_MONTH = r"(?i)\b([0-9]{1,2}) (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,? ([0-9]{4})"


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def _month_number(name: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(name))).cast("string")


def _parsed_date(text: Column) -> Column:
    part = F.regexp_extract
    iso = (
        F.when(F.rlike(text, F.lit(_NUMERIC_DATE)), _iso(*(part(text, _NUMERIC_DATE, i) for i in (1, 2, 3))))
        .when(
            F.rlike(text, F.lit(_MONTH_DAY)),
            _iso(part(text, _MONTH_DAY, 3), _month_number(part(text, _MONTH_DAY, 1)), part(text, _MONTH_DAY, 2)),
        )
        .when(
            F.rlike(text, F.lit(_DAY_MONTH)),
            _iso(part(text, _DAY_MONTH, 3), _month_number(part(text, _DAY_MONTH, 2)), part(text, _DAY_MONTH, 1)),
        )
    )
    return iso.try_cast("date")


def to_date(text: Column) -> Column:
    """DATE from year-first, Chinese or English month-name notation; NULL for anything else."""
    return let(text, _parsed_date)


def to_iso_date(text: Column) -> Column:
    return F.date_format(to_date(text), "yyyy-MM-dd")


def price_amount(text: Column) -> Column:
    """First number of a price text as DECIMAL(18,2)."""
    return F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("decimal(18,2)")


def price_currency(text: Column) -> Column:
    return (
        F.when(F.rlike(text, F.lit(r"[$]|(?i)\busd\b")), F.lit("USD"))
        .when(F.rlike(text, F.lit(r"[¥￥元]|(?i)\b(?:cny|rmb)\b")), F.lit("CNY"))
        .when(F.rlike(text, F.lit(r"€|(?i)\beur\b")), F.lit("EUR"))
    )


def _formatted_price(text: Column) -> Column:
    currency = price_currency(text)
    sign = (
        F.when(currency == "USD", F.lit("$")).when(currency == "CNY", F.lit("¥")).when(currency == "EUR", F.lit("€"))
    )
    return F.concat(sign, F.format_number(price_amount(text), 2))


def price_text(text: Column) -> Column:
    """``¥1,234.56`` or ``$1,234.56``; NULL when there is no number or no known currency."""
    return let(text, _formatted_price)


def tidy(text: Column) -> Column:
    """Drop tags, make punctuation ASCII, collapse whitespace to single blanks."""
    s = re_sub(text, r"</?[a-zA-Z][^>]*>", " ")
    s = let(s, lambda v: F.when(F.rlike(v, F.lit(f"[{FULL_WIDTH}]")), F.translate(v, FULL_WIDTH, ASCII_FORM)).otherwise(v))
    return F.btrim(re_sub(s, f"[{WS}]+", " "), F.lit(WS_CHARS))


def author_or_unknown(author: Column, language: Column) -> Column:
    """Tidy author name; the agreed placeholder in the page's language when there is none."""
    unknown = F.when(F.startswith(F.lower(language), F.lit("zh")), F.lit("未知")).otherwise(F.lit("Unknown"))
    return let(tidy(author), lambda a: F.coalesce(F.when(a != "", a), unknown))
