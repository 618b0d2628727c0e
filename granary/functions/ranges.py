"""Bounds of ranges as constants of a plan, and keys of text that sort as several columns do."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Bounds:
    """Values in ascending order, as texts, that are looked up by bisection."""

    values: tuple[str, ...]
    kind: T.DataType

    def value(self, i: int) -> Column:
        return F.lit(self.values[i]).cast(self.kind)

    def _count(self, x: Column, holds: Callable[[Column, Column], Column]) -> Column:
        """How many values e come before the first for which holds(e, x) isn't true."""
        ends = F.from_json(F.lit(json.dumps(self.values)), "array<string>").cast(f"array<{self.kind.simpleString()}>")
        steps = F.array(*(F.lit(2**k) for k in reversed(range(max(1, len(self.values).bit_length())))))
        found = lambda v: F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(holds(F.get(ends, n + step - 1), v), step).otherwise(0))
        return F.get(F.transform(F.array(x), found), 0)  # else Spark would compute x again in each step

    def upto(self, x: Column) -> Column:
        """How many values are at most x; 0 for null."""
        return self._count(x, lambda e, v: e <= v)

    def below(self, x: Column) -> Column:
        """How many values are less than x; 0 for null."""
        return self._count(x, lambda e, v: e < v)


def bounds_of(df: DataFrame, column: str, ranges: int, repeats: bool = False) -> Bounds:
    """Bounds between about `ranges` ranges of equally many rows: approximate quantiles of numbers and times, else what Spark's range partitioning finds. `repeats` keeps equal quantiles, which tell values that many rows have."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        ends = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 100_000).alias("ends")) if ranges > 1 else df.sparkSession.sql("SELECT array() AS ends")
    else:
        parts = df.select(column).repartitionByRange(ranges, column).groupBy(F.spark_partition_id()).agg(F.min(column).alias("low"))
        ends = parts.agg(F.collect_list("low").alias("ends"))  # `ranges` rows
    found = F.col("ends") if repeats else F.array_distinct("ends")
    return Bounds(tuple(e for e in ends.select(F.array_sort(found).cast("array<string>")).first()[0] or [] if e is not None), kind)


@dataclass(frozen=True)
class Order:
    """A column to order by, its direction and the place of nulls."""

    name: str
    desc: bool = False
    nulls_last: bool = False

    @staticmethod
    def parse(text: str) -> Order:
        """`name [ASC|DESC] [NULLS FIRST|NULLS LAST]`; nulls come first in ascending order and last in descending order unless said."""
        name, *words = text.split()
        said = " ".join(words).upper()
        place = said.partition("NULLS ")[2]
        desc = said.startswith("DESC")
        if said.partition("NULLS ")[0].strip() not in ("", "ASC", "DESC") or place not in ("", "FIRST", "LAST"):
            raise ValueError(f"no order: {text!r}")
        return Order(name, desc, place == "LAST" if place else desc)

    def column(self) -> Column:
        c = F.col(self.name)
        return (c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()) if self.desc else (c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first())


#: Digits of a key, the end of a text in it, and what they become in descending order.
_UP, _DOWN = "0123456789ABCDEF!", "FEDCBA9876543210~"


def _digits(x: Column, kind: T.DataType) -> Column:
    """Hexadecimal digits that sort as the value does."""
    if isinstance(kind, T.BooleanType):
        return x.cast("int").cast("string")
    if isinstance(kind, T.DecimalType):
        plain = F.lpad(F.regexp_replace(F.abs(x).cast("string"), r"\D", ""), kind.precision + 1, "0")
        return F.when(x < 0, F.concat(F.lit("0"), F.translate(plain, _UP, _DOWN))).otherwise(F.concat(F.lit("1"), plain))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(x.cast("double"), F.lit(0.0)) + F.lit(0.0)).cast("long")  # -0.0 + 0.0 is 0.0
        return F.lpad(F.hex(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(2**63))))), 16, "0")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.concat(F.hex(x.cast("binary")), F.lit("!"))
    if isinstance(kind, T.DateType):
        x = F.unix_date(x)
    elif isinstance(kind, T.TimestampType):
        x = F.unix_micros(x)
    elif isinstance(kind, T.TimestampNTZType):
        x = F.unix_micros(F.to_utc_timestamp(x.cast("timestamp"), F.current_timezone()))
    elif not isinstance(kind, T.IntegralType):
        raise ValueError(f"no order key for {kind.simpleString()}")
    return F.lpad(F.hex(x.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def order_key(df: DataFrame, order: Sequence[Order]) -> Column:
    """A text for each row that sorts, byte by byte, as the columns do in their directions and with nulls in their places."""
    parts = []
    for o in order:
        digits = _digits(F.col(o.name), df.schema[o.name].dataType)
        value = F.concat(F.lit("1"), F.translate(digits, _UP, _DOWN) if o.desc else digits)
        parts.append(F.when(F.col(o.name).isNull(), "2" if o.nulls_last else "0").otherwise(value))
    return F.concat(*parts)
