"""Ordered lists of groups of any size: pieces of ranges, put together in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.ranges import Order, bounds_of, order_key


def ordered_lists(df: DataFrame, group: Sequence[str], order: Sequence[str | Order], value: str, separator: str = ",", chunk_chars: int = 64_000_000, ranges: int = 1000) -> DataFrame:
    """(group columns, chunk, n_values, text): the group's values as text, joined in the order given.

    Rows are dealt to ranges of (group, order), each with about as many rows, and joined there to a piece for each group; a group's pieces are then joined in
    order. A group that is longer than `chunk_chars` is given in chunks 0, 1, ... of about that size, each some pieces, which
    joined by the separator are the whole list; so no task holds more than a range or a chunk. Null values are left out, as LISTAGG does; a group of nulls alone
    has n_values 0 and a null text. Ties in order are settled by the value. Null groups are groups.
    """
    by = [o if isinstance(o, Order) else Order.parse(o) for o in (*group, *order, value)]
    keyed = df.select(*group, F.col(value).cast("string").alias("_value"), order_key(df, by).alias("_key"))
    at = bounds_of(keyed, "_key", ranges)
    d = keyed.withColumn("_range", at.upto(F.col("_key")))
    piece = F.transform(F.array_sort(F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("_key", "_value")))), lambda x: x["_value"])
    pieces = d.groupBy(*group, "_range").agg(piece.alias("_list")).select(*group, "_range", F.size("_list").cast("long").alias("_n"), F.array_join("_list", separator).alias("_text"))
    # Windows over a row for each range of a group.
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("chunk", F.floor(F.coalesce(F.sum(F.char_length("_text")).over(before), F.lit(0)) / chunk_chars).cast("long"))
    full = F.array_sort(F.collect_list(F.when(F.col("_n") > 0, F.struct("_range", "_text"))))
    out = pieces.groupBy(*group, "chunk").agg(F.sum("_n").alias("n_values"), full.alias("_texts"))
    text = F.array_join(F.transform("_texts", lambda x: x["_text"]), separator)
    dense = F.row_number().over(Window.partitionBy(*group).orderBy("chunk")).cast("long") - 1
    return out.select(*group, dense.alias("chunk"), "n_values", F.when(F.col("n_values") > 0, text).alias("text"))
