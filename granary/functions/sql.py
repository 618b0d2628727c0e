"""Scalar functions with SQL's meaning where Spark's own differ."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of format masks and Spark's letters for them.
MASK = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "MON": "MMM", "MONTH": "MMMM", "DD": "dd", "DY": "EEE", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "FF": "SSSSSS", "AM": "a", "PM": "a"}


def mask(text: str) -> str:
    """A format mask (DD.MM.YYYY HH24:MI:SS) in Spark's letters; other letters become quoted text."""
    keys = "|".join(sorted(MASK, key=len, reverse=True))
    return re.sub(rf"({keys})|([A-Za-z]+)", lambda m: MASK[m[1].upper()] if m[1] else f"'{m[2]}'", text, flags=re.I)


def cast_with_mask(column: Column, kind: str, text: str) -> Column:
    return F.to_date(column, mask(text)) if kind.upper() == "DATE" else F.to_timestamp_ntz(column, F.lit(mask(text)))


def to_char(column: Column, text: str) -> Column:
    """A time as text by a format mask."""
    return F.date_format(column, mask(text))


def to_number(column: Column, kind: str = "decimal(38,10)") -> Column:
    """The number that a text is; null if it is none."""
    return F.trim(column).try_cast(kind)


def trunc(column: Column) -> Column:
    """TRUNC of a time: its day."""
    return F.to_date(column)


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, b)


def title(column: Column) -> Column:
    """A display name of an identifier: order_id is Order Id."""
    return F.initcap(F.replace(F.lower(column), F.lit("_"), F.lit(" ")))


def case(target: Column, branches: list[tuple[Column, Column]], default: Column) -> Column:
    """CASE target WHEN ...; the first equal value counts."""
    out = F
    for value, result in branches:
        out = out.when(target == value, result)
    return out.otherwise(default)


def metadata(comment: Column) -> Column:
    """@KEY: value lines of a comment as a map; a backslash at a line's end continues it, and the last of equal keys counts."""
    lines = F.regexp_extract_all(F.regexp_replace(comment, r"\s*\\\n\s*", " "), F.lit(r"(?m)^\s*@\w+:[^\n]*"), F.lit(0))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"@(\w+):", 1).alias("key"), F.trim(F.regexp_extract(x, r":([^\n]*)", 1)).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))
