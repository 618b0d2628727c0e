"""OFFSET and LIMIT over sorted tables without sorting them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.ranges import Order, order_key


def offset_rows(df: DataFrame, order: Sequence[str | Order], n: int, ranges: int = 200, limit: int | None = None) -> DataFrame:
    """df in the given order without its first n rows, and of the rest the first `limit` if that is given.

    `order` names columns of any types that sort, each with its direction and the place of its nulls (`name DESC NULLS FIRST`, or Order). A row's
    key is a text that sorts as these do, with a hash of the row at its end, so that ties are split as well; the rows are counted
    by ranges of that key, as Spark's range partitioning deals them. In the range of a cut keys are counted in order, which gives the key at the cut, and rows
    are kept by comparing keys with it. Which of tied rows go is settled by the hash; equal rows can't be told apart. An empty table gives an empty result.
    """
    by = [o if isinstance(o, Order) else Order.parse(o) for o in order]
    key = F.col("_key")
    keyed = df.withColumn("_key", F.concat(order_key(df, by), F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0")))
    dealt = keyed.select(key).repartitionByRange(ranges, key).groupBy(F.spark_partition_id())  # equal keys are in one range
    parts = sorted(dealt.agg(F.min(key).alias("low"), F.count("*").alias("n")).select("low", "n").collect())  # a row for each range
    n, total = max(n, 0), sum(count for _, count in parts)
    stop = total if limit is None else min(n + limit, total)

    def at(place: int) -> tuple[str, int, int]:
        """The key of the row that `place` rows precede, and where the rows with that key begin and end."""
        r, first = 0, 0
        while first + parts[r][1] <= place:
            r, first = r + 1, first + parts[r][1]
        here = keyed.filter(key >= parts[r][0])
        here = here.filter(key < parts[r + 1][0]) if r + 1 < len(parts) else here
        here = here.groupBy(key).count().withColumn("_end", first + F.sum("count").over(Window.orderBy(key)))
        found = here.filter((F.col("_end") > place) & (F.col("_end") - F.col("count") <= place)).first()
        return found["_key"], found["_end"] - found["count"], found["_end"]

    out, split = keyed if n < stop else keyed.limit(0), {}
    if 0 < n < stop:
        cut, begin, end = at(n)
        out = out.filter(key >= cut if begin == n else key > cut)
        if begin < n:
            split[cut] = min(end, stop) - n
    if n < stop < total:
        cut, begin, _ = at(stop)
        out = out.filter(key < cut)
        if begin < stop:
            split[cut] = stop - max(begin, n)
    for cut, some in split.items():
        out = out.unionByName(keyed.filter(key == cut).limit(some))
    return out.drop("_key").orderBy(*(o.column() for o in by))
