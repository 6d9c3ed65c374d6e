"""The closed language of predicates over properties, as Column expressions.

Three-valued logic is SQL's; a null search text counts as an empty one; a null in
a list of values matches null; booleans that are null match neither way.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def equals(c: Column, value) -> Column:
    return c.isNull() if value is None else c == value


def not_equals(c: Column, value) -> Column:
    return c.isNotNull() if value is None else c != value


def is_true(c: Column) -> Column:
    return c == F.lit(True)


def is_false(c: Column) -> Column:
    return c == F.lit(False)


def text_concat(*parts: Column) -> Column:
    """Parts one after another; null is empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def starts_with(c: Column, text: str | None) -> Column:
    return c.startswith(text or "")


def ends_with(c: Column, text: str | None) -> Column:
    return c.endswith(text or "")


def contains(c: Column, text: str | None) -> Column:
    return c.contains(text or "")


def is_null_or_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def is_null_or_blank(c: Column) -> Column:
    """Null, empty or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def one_of(c: Column, values: Iterable) -> Column:
    values = list(dict.fromkeys(values))
    some = [v for v in values if v is not None]
    found = c.isin(some) if some else F.lit(False)
    return found | c.isNull() if len(some) < len(values) else found
