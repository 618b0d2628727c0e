"""Materialised views of grouped tables and joins that are kept by changes, not computed anew."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.scratch import stored

#: Sign of a row in a table of changes: 1 for a row that came, -1 for one that went.
SIGN = "_sign"


@dataclass(frozen=True)
class View:
    """SELECT groups, count(*), and for named columns count, sum, avg, min or max, GROUP BY groups. `measures` maps names of the result to (function, column).

    Sums are decimals of `scale` digits, so that what is added and taken away again leaves no trace.
    """

    groups: tuple[str, ...]
    measures: dict[str, tuple[str, str]] = field(default_factory=dict)
    count: str = "n"
    scale: int = 6

    def __post_init__(self) -> None:
        bad = sorted({f for f, _ in self.measures.values()} - {"count", "sum", "avg", "min", "max"})
        if bad:
            raise ValueError(f"no measure {', '.join(bad)}")

    def _of(self, *functions: str) -> list[str]:
        return sorted({c for f, c in self.measures.values() if f in functions})

    def _sum(self, column: str) -> Column:
        return F.col(column).cast(T.DecimalType(38, self.scale))


def signed(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows that changes of rowdiff.diff take away and bring, with SIGN: an update is one of each. Columns that only one side has are null on the other."""
    kinds = {side: changes.schema[side].dataType for side in ("old", "new")}
    fields = {side: {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {} for side, kind in kinds.items()}
    names = fields["old"] | fields["new"]

    def rows(side: str, ops: tuple[str, str], sign: int) -> DataFrame:
        value = lambda n: F.col(side)[n] if n in fields[side] else F.lit(None)
        return changes.filter(F.col("op").isin(*ops)).select(*key, *(value(n).cast(kind).alias(n) for n, kind in names.items()), F.lit(sign).alias(SIGN))

    return rows("old", ("UPDATE", "DELETE"), -1).unionByName(rows("new", ("UPDATE", "INSERT"), 1))


def joined(left_old: DataFrame, left_changes: DataFrame, right_new: DataFrame, right_changes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Signed changes of left JOIN right USING (on), from signed changes of both: changes of the left meet the right as it is now, changes of the right the left as it was. Null keys meet nothing."""
    one = left_changes.join(right_new, list(on))
    two = left_old.join(right_changes, list(on))
    return one.unionByName(two)


def build(rows: DataFrame, view: View) -> DataFrame:
    """The view's state over all rows: what it shows, and counts of values and sums, by which it is kept."""
    aggs = [F.count("*").alias(view.count)]
    aggs += [F.count(c).alias(f"_n_{c}") for c in view._of("count", "sum", "avg", "min", "max")]
    aggs += [F.sum(view._sum(c)).alias(f"_sum_{c}") for c in view._of("sum", "avg")]
    aggs += [F.min(c).alias(f"_min_{c}") for c in view._of("min")] + [F.max(c).alias(f"_max_{c}") for c in view._of("max")]
    return rows.groupBy(*view.groups).agg(*aggs)


def _delta(changes: DataFrame, view: View) -> DataFrame:
    """By group: the change of each count and sum, the least and greatest values that came and that went. Rows are first netted, so that one which came and went is neither."""
    used = list(dict.fromkeys([*view.groups, *view._of("count", "sum", "avg", "min", "max")]))
    changes = changes.groupBy(*used).agg(F.sum(SIGN).alias(SIGN)).filter(f"{SIGN} <> 0") if used else changes
    sign, came, gone = F.col(SIGN), F.col(SIGN) > 0, F.col(SIGN) < 0
    aggs = [F.sum(sign).alias("_d")]
    aggs += [F.sum(F.when(F.col(c).isNotNull(), sign).otherwise(0)).alias(f"_dn_{c}") for c in view._of("count", "sum", "avg", "min", "max")]
    aggs += [F.sum(F.coalesce(view._sum(c) * sign, F.lit(0).cast(T.DecimalType(38, view.scale)))).alias(f"_dsum_{c}") for c in view._of("sum", "avg")]
    for f, c in [("min", c) for c in view._of("min")] + [("max", c) for c in view._of("max")]:
        of = getattr(F, f)
        aggs += [of(F.when(came, F.col(c))).alias(f"_{f}_in_{c}"), of(F.when(gone, F.col(c))).alias(f"_{f}_out_{c}")]
    return changes.groupBy(*view.groups).agg(*aggs)


def apply(state: DataFrame, changes: DataFrame, rows_now: DataFrame, view: View) -> DataFrame:
    """The state after signed changes. `rows_now` are the rows below the view as they are now.

    Changes are summed by group and added to the state by one null-safe join. A group whose least or greatest value went, with none as far out that
    came, has it computed anew from rows_now, which is read for such groups alone and not at all if there is none. Groups without rows go. Null groups are groups; a group may have come
    and gone within the changes; changes that cancel each other change nothing.
    """
    names = list(view.groups)
    counted, summed = view._of("count", "sum", "avg", "min", "max"), view._of("sum", "avg")
    ends = [("min", c) for c in view._of("min")] + [("max", c) for c in view._of("max")]
    d = _delta(changes, view)
    d = stored(d.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(names)), *(c for c in d.columns if c not in names)), "view-changes")
    on = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(names)), F.lit(True))
    j = state.join(d, on, "full_outer") if names else state.crossJoin(d)  # one row each
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    there = F.col(view.count).isNotNull()
    columns = [(F.when(there, F.col(g)).otherwise(F.col(f"_g{i}"))).alias(g) for i, g in enumerate(names)]
    columns += [(zero(view.count) + zero("_d")).alias(view.count)]
    columns += [(zero(f"_n_{c}") + zero(f"_dn_{c}")).alias(f"_n_{c}") for c in counted]
    exact = T.DecimalType(38, view.scale)
    columns += [F.when(zero(f"_n_{c}") + zero(f"_dn_{c}") > 0, (zero(f"_sum_{c}") + zero(f"_dsum_{c}")).cast(exact)).alias(f"_sum_{c}") for c in summed]
    lost = []
    for f, c in ends:
        best, had, came, went = F.least if f == "min" else F.greatest, F.col(f"_{f}_{c}"), F.col(f"_{f}_in_{c}"), F.col(f"_{f}_out_{c}")
        within = (lambda a, b: a <= b) if f == "min" else (lambda a, b: a >= b)
        # What went reaches the end, and nothing that came is beyond or at the end before.
        gone = F.coalesce(within(went, had) & ~F.coalesce(within(came, had), F.lit(False)), went.isNotNull() & had.isNull())
        lost.append(F.coalesce(gone, F.lit(False)))
        columns.append(F.when(zero(f"_n_{c}") + zero(f"_dn_{c}") > 0, best(had, came)).alias(f"_{f}_{c}"))
    out = j.select(*columns, reduce(lambda a, b: a | b, lost, F.lit(False)).alias("_lost")).filter(F.col(view.count) > 0)
    if not ends:
        return out.drop("_lost")
    out = stored(out, "view-state")
    again = out.filter("_lost").select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(names)))
    if again.isEmpty():
        return out.drop("_lost")
    rows = rows_now.join(again, on, "left_semi") if names else rows_now
    anew = build(rows, view)
    values = [f"_{f}_{c}" for f, c in ends]
    anew = anew.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(names)), *(F.col(v).alias(f"_new{v}") for v in values), F.lit(True).alias("_anew"))
    both = out.join(anew, on & F.col("_lost"), "left") if names else out.crossJoin(anew)
    return both.select(*(F.when(F.col("_anew"), F.col(f"_new{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in out.columns if c != "_lost"))


def show(state: DataFrame, view: View) -> DataFrame:
    """What the view shows: groups, the count and the measures, an average as a double."""
    value = {
        "count": lambda c: F.col(f"_n_{c}"),
        "sum": lambda c: F.col(f"_sum_{c}"),
        "avg": lambda c: F.col(f"_sum_{c}").cast("double") / F.when(F.col(f"_n_{c}") > 0, F.col(f"_n_{c}")),
        "min": lambda c: F.col(f"_min_{c}"),
        "max": lambda c: F.col(f"_max_{c}"),
    }
    return state.select(*view.groups, view.count, *(value[f](c).alias(name) for name, (f, c) in view.measures.items()))
