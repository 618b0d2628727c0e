"""INSERT, UPDATE, DELETE and MERGE as transformations: each gives the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(into: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Adds rows, matched to `columns` by position (all columns if none are named). Columns not named get their default or null."""
    named = list(columns or into.columns)
    if len(named) != len(rows.columns):
        raise ValueError(f"{len(named)} columns and {len(rows.columns)} values")
    types, r = dict(into.dtypes), rows.toDF(*named)
    value = lambda c: F.col(c) if c in named else (defaults or {}).get(c, F.lit(None))
    return into.unionByName(r.select(*(value(c).cast(types[c]).alias(c) for c in into.columns)))


def insert_or_replace(into: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds rows; of those with the same key the old ones go."""
    return into.join(rows.select(*key).distinct(), list(key), "left_anti").select(into.columns).unionByName(rows)


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Sets columns where the condition is true; it reads the row as it was."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(dict(df.dtypes)[c]) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Drops rows for which the condition is true, not those for which it is null."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def merge(into: DataFrame, using: DataFrame, key: Sequence[str], matched: dict[str, Column], insert_values: dict[str, Column], matched_where: Column | None = None) -> DataFrame:
    """Rows of `into` with a match by key get `matched` (where `matched_where` holds); rows of `using` without one are inserted. Expressions name columns t.x and u.x."""
    t, u = into.withColumn("_t", F.lit(True)).alias("t"), using.withColumn("_u", F.lit(True)).alias("u")
    on = reduce(lambda x, y: x & y, (F.col(f"t.{k}") == F.col(f"u.{k}") for k in key))
    j = t.join(u, on, "full_outer")
    old, new = F.col("t._t").isNotNull(), F.col("u._u").isNotNull()
    hit = old & new & (F.coalesce(matched_where, F.lit(False)) if matched_where is not None else F.lit(True))
    types = dict(into.dtypes)
    value = lambda c: F.when(hit & F.lit(c in matched), matched.get(c, F.lit(None))).when(old, F.col(f"t.{c}")).otherwise(insert_values.get(c, F.lit(None)))
    return j.select(*(value(c).cast(types[c]).alias(c) for c in into.columns))
