"""Bind a computed column once inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column] | str) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it.

    Higher-order functions are interpreted, so a long regular-expression chain used three
    times in a body would otherwise run three times. A long body may be given as SQL text over
    the name ``v``, which builds much faster than hundreds of Column objects.
    """
    if isinstance(body, str):
        bound = F.call_function("transform", F.array(value), F.expr(f"v -> {body}"))
    else:
        bound = F.transform(F.array(value), body)
    return F.get(bound, F.lit(0))


def sql_let(name: str, value: str, body: str) -> str:
    """The same inside SQL text."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def quoted(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
