"""Joins and membership with the meaning that SQL gives them, where the DataFrame API needs care."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_join(left: DataFrame, right: DataFrame, on: Column | None = None) -> DataFrame:
    """Equal on all columns that both have; a further condition filters what is joined."""
    shared = [c for c in left.columns if c in right.columns]
    j = left.join(right, shared, "inner") if shared else left.crossJoin(right)
    return j if on is None else j.filter(on)


def outer_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """A bare OUTER JOIN is a full one."""
    return left.join(right, on, "full_outer")


def in_subquery(df: DataFrame, columns: Sequence[str], rows: DataFrame) -> DataFrame:
    """Rows whose columns, as a tuple, are among rows."""
    r = rows.toDF(*(f"_in{i}" for i in range(len(columns)))).distinct()
    return df.join(r, reduce(lambda x, y: x & y, (F.col(c) == F.col(f"_in{i}") for i, c in enumerate(columns))), "left_semi")


def not_in_subquery(df: DataFrame, column: str, rows: DataFrame) -> DataFrame:
    """Rows whose column is surely not among rows: none if rows has a null, and no row with a null unless rows is empty."""
    r = rows.toDF("_in")
    facts = r.agg(F.count("*").alias("_n"), F.count_if(F.col("_in").isNull()).alias("_nulls"))
    left = df.join(F.broadcast(facts), F.lit(True)).filter("_nulls = 0").filter((F.col("_n") == 0) | F.col(column).isNotNull())  # facts is one row
    return left.join(r.distinct(), F.col(column) == F.col("_in"), "left_anti").select(df.columns)


def lookup_with_default(df: DataFrame, other: DataFrame, key: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    """Left join on the key; columns without a match get their default."""
    j = df.join(other, list(key), "left")
    return j.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def status_join(left: DataFrame, right: DataFrame, key: Sequence[str], names: tuple[str, str] = ("LEFT", "RIGHT")) -> DataFrame:
    """Keys of both sides with where they are: BOTH, <name>_ONLY."""
    a, b = left.select(*key).distinct().withColumn("_a", F.lit(1)), right.select(*key).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_b").isNull(), f"{names[0]}_ONLY").when(F.col("_a").isNull(), f"{names[1]}_ONLY").otherwise("BOTH")
    return a.join(b, list(key), "full_outer").select(*key, status.alias("status"))
