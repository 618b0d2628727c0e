"""Joins by inequality alone: points with the intervals that hold them, without comparing all rows with all, and their totals without the pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.ranges import bounds_of
from granary.scratch import stored

#: Comparisons of theta_join, and the end of the interval that the right column is.
OPERATORS = {"<": ("high", False), "<=": ("high", True), ">": ("low", False), ">=": ("low", True)}


def _fresh(name: str, *dfs: DataFrame) -> str:
    taken = {c.lower() for d in dfs for c in d.columns}
    while name in taken:
        name += "_"
    return name


def _apart(a: Sequence[str], b: Sequence[str]) -> None:
    shared = {c.lower() for c in a} & {c.lower() for c in b}
    if shared:
        raise ValueError(f"both sides have {', '.join(sorted(shared))}")


def _holds(low: str | None, high: str | None, closed: tuple[bool, bool]) -> Column:
    """Whether an interval may hold a point."""
    if low and high:
        return F.col(low) <= F.col(high) if all(closed) else F.col(low) < F.col(high)
    return F.col(low or high).isNotNull()


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str | None, high: str | None, closed: tuple[bool, bool] = (True, True), how: str = "inner", bins: int = 256, on: Column | None = None) -> DataFrame:
    """Rows of both with low <= point <= high; `closed` says which ends belong to the interval, None for `low` or `high` that there is no such end, `on` what else must hold.

    Points are binned by their quantiles, and each interval is repeated for the bins it reaches into, so this is an equi-join of bins with an exact
    condition. A value that many points have spans several bins; its points are spread over them by a hash of the row, and intervals go to all. An interval is in at
    most `bins` bins, a point in one, so no pair comes twice, and `how` may also be left, left_semi or left_anti. Nulls meet nothing. The names of columns must differ.
    Repeated intervals are many more than their table lets Spark expect, so they are merged, never broadcast.
    """
    _apart(points.columns, intervals.columns)
    at = bounds_of(points, point, bins, repeats=True)
    a, b = _fresh("_bin", points, intervals), _fresh("_bins", points, intervals)
    p = F.col(point)
    first, last = at.below(p), at.upto(p)
    dealt = points.withColumn(a, F.when(p.isNotNull(), first + F.pmod(F.xxhash64(*points.columns), last - first + 1).cast("int")))
    from_, to = at.below(F.col(low)) if low else F.lit(0), at.upto(F.col(high)) if high else F.lit(len(at.values))
    there = F.lit(True)
    if low and high:
        there = F.col(low) <= F.col(high)
    elif low or high:
        there = F.col(low or high).isNotNull()
    reach = intervals.withColumn(b, F.explode(F.when(there, F.sequence(from_, F.greatest(to, from_)))))
    holds = F.col(a) == F.col(b)
    if low:
        holds &= p >= F.col(low) if closed[0] else p > F.col(low)
    if high:
        holds &= p <= F.col(high) if closed[1] else p < F.col(high)
    return dealt.join(reach.hint("merge"), holds if on is None else holds & on, how).drop(a, b)


def interval_totals(points: DataFrame, intervals: DataFrame, point: str, low: str | None, high: str | None, closed: tuple[bool, bool] = (True, True), sums: Sequence[str] = (), by: Sequence[str] = (), of: Sequence[str] = (), how: str = "inner", bins: int = 256) -> DataFrame:
    """`interval_join` grouped by `of` (columns of intervals) and `by` (columns of points): `n` pairs, and for each integer column of points in `sums` how many values are not null, and their sum, as `n_` and `sum_` with its name.

    No pair is made. An interval holds what lies up to its high end, less what lies up to its low end, so an end is looked up in running totals of the points and counts 1 or -1. Equal points are added up first, and equal
    ends of a group; then points and ends lie in ranges of about equally many different values, with running totals in each, and the totals of the ranges before (a row for each range and group of `by`) are added.
    Every end is looked up for every group of `by`. Totals are integers of 38 digits on the way. `how` may be left, without `by`: groups of intervals that meet nothing stay, with 0 and null. Nulls meet nothing.
    """
    _apart([point, *by, *sums], [c for c in (low, high, *of) if c])
    if not (low or high) or how not in ("inner", "left") or how == "left" and by:
        raise ValueError("intervals have an end, and `how` is inner, or left without `by`")
    wrong = [s for s in sums if not isinstance(points.schema[s].dataType, T.IntegralType)]
    if wrong:
        raise ValueError(f"no integers: {', '.join(wrong)}")
    exact = "decimal(38,0)"
    groups, kinds = [f"_by{k}" for k in range(len(by))], [f"_of{k}" for k in range(len(of))]
    by_, of_ = [F.col(c).alias(g) for c, g in zip(by, groups)], [F.col(c).alias(k) for c, k in zip(of, kinds)]
    adds = {"_n": F.count("*")}
    for k, s in enumerate(sums):
        adds |= {f"_n{k}": F.count(s), f"_sum{k}": F.coalesce(F.sum(F.col(s).cast("decimal(20,0)")), F.lit(0))}
    summed = [F.sum(m).alias(m) for m in adds]
    zeros = [F.lit(0).cast(exact).alias(m) for m in adds]

    seen = points.filter(F.col(point).isNotNull()).groupBy(F.col(point).alias("_value"), *by_).agg(*(x.cast(exact).alias(m) for m, x in adds.items()))
    seen = stored(seen.withColumn("_place", F.lit(1)), "interval-points")
    # An end comes before (0) or after (2) the points that equal it.
    held = intervals.filter(_holds(low, high, closed))
    sides = [(low, 0 if closed[0] else 2, -1), (high, 2 if closed[1] else 0, 1)]
    signed = F.explode(F.array(*(F.struct(F.col(end).alias("_value"), F.lit(place).alias("_place"), F.lit(sign).alias("_sign")) for end, place, sign in sides if end)))
    ends = held.select(*of_, signed.alias("_end")).select(*kinds, "_end.*").groupBy(*kinds, "_value", "_place").agg(F.sum("_sign").alias("_sign"))
    ends = stored(ends.filter("_sign <> 0"), "interval-ends")

    asked = ends.select("_value", "_place").distinct()
    line = seen.unionByName((asked.crossJoin(seen.select(*groups).distinct()) if by else asked).select("*", *zeros))
    at = bounds_of(seen.select("_value").union(asked.select("_value")), "_value", bins)
    line = line.withColumn("_range", at.upto(F.col("_value")))
    here = Window.partitionBy("_range", *groups).orderBy("_value", "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = line.groupBy("_range", *groups).agg(*summed).select("_range", *groups, *(F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(m) for m in adds))
    running = line.select("_range", *groups, "_value", "_place", *(F.sum(m).over(here).alias(m) for m in adds)).filter("_place <> 1").alias("r")
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"b.{g}")) for g in ["_range", *groups]]
    upto = running.join(before.alias("b"), same).select("_value", "_place", *(F.col(f"r.{g}") for g in groups), *((F.col(f"r.{m}") + F.col(f"b.{m}")).alias(m) for m in adds))

    parts = ends.join(upto, ["_value", "_place"])
    if not high:
        parts = parts.unionByName(held.groupBy(*of_).agg(F.count("*").alias("_sign")).crossJoin(seen.groupBy(*groups).agg(*summed)), allowMissingColumns=True)
    parts = parts.select(*kinds, *groups, *((F.col("_sign") * F.col(m)).alias(m) for m in adds))
    if how == "left":
        parts = parts.unionByName(intervals.select(*of_, *zeros))
    out = parts.groupBy(*kinds, *groups).agg(*summed)
    if how == "inner":
        out = out.filter("_n > 0")
    named = [F.col("_n").cast("long").alias("n")]
    for k, s in enumerate(sums):
        named += [F.col(f"_n{k}").cast("long").alias(f"n_{s}"), F.when(F.col(f"_n{k}") > 0, F.col(f"_sum{k}")).cast("long").alias(f"sum_{s}")]
    return out.select(*(F.col(k).alias(c) for c, k in zip(of, kinds)), *(F.col(g).alias(c) for c, g in zip(by, groups)), *named)


def theta_join(left: DataFrame, right: DataFrame, column: str, operator: str, other: str, how: str = "inner", bins: int = 256) -> DataFrame:
    """left.column < right.other, or <=, >, >=, and no other condition: intervals with one end."""
    if operator not in OPERATORS:
        raise ValueError(f"no operator {operator!r}; there are {', '.join(OPERATORS)}")
    end, closed = OPERATORS[operator]
    return interval_join(left, right, column, other if end == "low" else None, other if end == "high" else None, (closed, closed), how, bins)


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], bins: int = 256) -> DataFrame:
    """Pairs of intervals that share a point: one begins within the other, which is an interval join each way; that both begin together counts once."""
    one = interval_join(left, right, left_ends[0], *right_ends, bins=bins, on=F.col(left_ends[0]) <= F.col(left_ends[1]))
    two = interval_join(right, left, right_ends[0], *left_ends, closed=(False, True), bins=bins, on=F.col(right_ends[0]) <= F.col(right_ends[1]))
    return one.unionByName(two)
