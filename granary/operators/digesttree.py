"""Comparing two states by trees of digests: only ranges of keys whose digests differ are read again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.ranges import Bounds, bounds_of
from granary.operators.rowdiff import DiffError, key_of
from granary.scratch import stored

#: Ranges below a node of the tree, hash parts of a range, and ranges that are read by a filter each; where more differ, one filter spans them all.
FANOUT, PARTS, MOST_FILTERS = 32, 64, 64
SUMS = ("n", "d0", "d1", "d2", "d3")


@dataclass(frozen=True)
class Layout:
    """How keys fall into leaves: ranges of the first key column, each cut in PARTS by a hash of the whole key."""

    key: tuple[str, ...]
    columns: tuple[str, ...]
    bounds: Bounds

    def range_of(self) -> Column:
        """The number of the key's range; null keys are in the first."""
        return self.bounds.upto(F.col(self.key[0]))

    def leaf_of(self) -> Column:
        return (self.range_of() * PARTS + F.pmod(F.xxhash64(*self.key), F.lit(PARTS))).cast("long")

    def within(self, ranges: Sequence[int]) -> Column:
        """A filter on the first key column that a scan can use: rows of the ranges, and of ranges between them if there are over MOST_FILTERS apart."""
        spans: list[list[int]] = []
        for r in sorted(ranges):
            if spans and r == spans[-1][1] + 1:
                spans[-1][1] = r
            else:
                spans.append([r, r])
        if len(spans) > MOST_FILTERS:
            spans = [[spans[0][0], spans[-1][1]]]
        k = F.col(self.key[0])

        def one(low: int, high: int) -> Column:
            last = high == len(self.bounds.values)
            if not low:
                return F.lit(True) if last else k.isNull() | (k < self.bounds.value(high))
            return k >= self.bounds.value(low - 1) if last else (k >= self.bounds.value(low - 1)) & (k < self.bounds.value(high))

        return reduce(lambda a, b: a | b, (one(*s) for s in spans), F.lit(False))


def layout(df: DataFrame, key: Sequence[str], ranges: int = 1024) -> Layout:
    """A layout of about `ranges` ranges with equally many keys."""
    names = tuple(key_of("table", df, key))
    return Layout(names, tuple(c for c in df.columns if c not in names), bounds_of(df, names[0], ranges))


def _digest(columns: Sequence[str]) -> list[Column]:
    """Four numbers of 32 bits from two hashes of a row; a null is hashed as such."""
    known = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    hashes = [F.xxhash64(*known, F.lit(i)) for i in range(2)]
    return [x for h in hashes for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]


def digests(df: DataFrame, at: Layout) -> DataFrame:
    """(level, node, n, d0 to d3): the tree's nodes. Leaves sum their rows' digests, so order doesn't matter and equal rows don't cancel; a node sums its children: level 3 are leaves, 2 ranges, 1 FANOUT ranges, 0 the root.

    One scan and one aggregation that combines before the shuffle. A table of digests is small, whatever the table (a row for each leaf), and can be kept in place of a state.
    """
    columns = [*at.key, *at.columns]
    parts = _digest(columns)
    leaves = df.select(at.leaf_of().alias("node"), F.lit(1).alias("n"), *(p.alias(f"d{i}") for i, p in enumerate(parts)))
    level = leaves.groupBy("node").agg(*(F.sum(s).alias(s) for s in SUMS)).select(F.lit(3).alias("level"), "node", *SUMS)
    level, out = stored(level, "leaves"), []
    out.append(level)
    for depth, width in ((2, PARTS), (1, FANOUT), (0, 1 << 62)):
        level = level.groupBy(F.expr(f"node div {width}L").alias("node")).agg(*(F.sum(s).alias(s) for s in SUMS)).select(F.lit(depth).alias("level"), "node", *SUMS)
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node) of the leaves whose digests differ, of two tables of digests of one layout. Goes down from the root, into children of nodes that differ only."""
    found = None
    for depth, width in ((0, 0), (1, 1 << 62), (2, FANOUT), (3, PARTS)):
        a, b = (d.filter(F.col("level") == depth).select("node", F.struct(*SUMS).alias(side)) for d, side in ((old, "a"), (new, "b")))
        if found is not None:
            up = F.broadcast(found.withColumnRenamed("node", "parent"))  # at most a row for each leaf
            a, b = (d.join(up, F.expr(f"node div {width}L") == F.col("parent"), "left_semi") for d in (a, b))
        found = a.join(b, "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        if not depth and found.isEmpty():
            break
    return stored(found, "differing")


def opened(df: DataFrame, at: Layout, leaves: DataFrame) -> DataFrame:
    """The rows of df in leaves: ranges without such a leaf are left out by a filter on the first key column, which the scan uses."""
    ranges = [r[0] for r in leaves.select(F.expr(f"node div {PARTS}L")).distinct().collect()]  # at most the layout's ranges
    d = df.filter(at.within(ranges)) if ranges else df.limit(0)
    return d.join(F.broadcast(leaves), at.leaf_of() == F.col("node"), "left_semi")  # at most a row for each leaf


def compare(old: DataFrame, new: DataFrame, key: Sequence[str], ranges: int = 1024, old_digests: DataFrame | None = None, at: Layout | None = None) -> DataFrame:
    """(key columns, side, n_old, n_new) for each key whose rows differ: side is `old` or `new` where only that side has rows without an equal one on the other, else `both`; the numbers count such rows.

    Rows are compared by the columns of `old` (`new` must have them); equal rows are matched one to one, so repeated rows and keys count. Nulls equal nulls, in keys too. Each side is
    read once for its digests (`old_digests`, with their layout, if that was done before) and then only where digests of 128 bits differ. An empty side differs in all rows of the other.
    """
    at = at or layout(old, key, ranges)
    missing = [c for c in (*at.key, *at.columns) if c not in new.columns]
    if missing:
        raise DiffError(f"the new state lacks {', '.join(missing)}")
    leaves = differing(stored(old_digests if old_digests is not None else digests(old, at), "old-digests"), stored(digests(new, at), "new-digests"))
    names = [*at.key, *at.columns]
    kinds = {f.name: f.dataType for f in old.schema.fields}
    rows = lambda d, n: opened(d, at, leaves).select(*(F.col(c).cast(kinds[c]) for c in names), F.lit(n).alias("_n"))
    both = rows(old, 1).unionByName(rows(new, -1)).groupBy(*names).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    out = both.groupBy(*at.key).agg(F.sum(F.greatest("_n", F.lit(0))).alias("n_old"), F.sum(F.greatest(-F.col("_n"), F.lit(0))).alias("n_new"))
    side = F.when(F.col("n_new") == 0, "old").when(F.col("n_old") == 0, "new").otherwise("both")
    return out.select(*at.key, side.alias("side"), "n_old", "n_new")


def compare_tables(old: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, Sequence[str]], ranges: int = 1024) -> DataFrame:
    """(table_name, status, n_keys, message) for each table that both sides have: IDENTICAL, DIFFERENT with the number of keys that differ, or FAILED with the reason."""
    spark, out = next(iter(old.values())).sparkSession, []
    for name in sorted(set(old) & set(new)):
        try:
            n = compare(old[name], new[name], key_of(name, old[name], keys.get(name)), ranges).count()
            out.append((name, "DIFFERENT" if n else "IDENTICAL", n, None))
        except DiffError as e:
            out.append((name, "FAILED", None, str(e)))
    return spark.createDataFrame(out, "table_name string, status string, n_keys long, message string")
