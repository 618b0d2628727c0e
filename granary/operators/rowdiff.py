"""Row differ: two states of a table, joined on their key, become the changes that lead from one to the other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DiffError(ValueError):
    """A table that can't be compared, and why."""


def key_of(name: str, df: DataFrame, key: Sequence[str] | None, primary_keys: dict[str, Sequence[str]] | None = None) -> list[str]:
    """The key given, or the table's primary key by its upper-case or exact name; columns are looked up without regard to case."""
    known = primary_keys or {}
    found = key or known.get(name.upper()) or known.get(name)
    if not found:
        raise DiffError(f"{name}: no key given and no primary key known")
    columns = {c.upper(): c for c in df.columns}
    missing = [k for k in found if k.upper() not in columns]
    if missing:
        raise DiffError(f"{name}: no such key column: {', '.join(missing)}")
    return [columns[k.upper()] for k in found]


def _sided(df: DataFrame, key: Sequence[str], side: str, last_by: Sequence[str] | None) -> DataFrame:
    """Key columns k0.. , a struct of the others, and a mark; of rows with a key the last by `last_by` if that is given."""
    rest = [c for c in df.columns if c not in key]
    out = df.select(*(F.col(k).alias(f"{side}k{i}") for i, k in enumerate(key)), F.struct(*rest, F.lit(True).alias("_there")).alias(side), *([F.struct(*last_by).alias("_at")] if last_by else []))
    if last_by:
        out = out.groupBy(*(f"{side}k{i}" for i in range(len(key)))).agg(F.max_by(side, "_at").alias(side))
    return out


def diff(old: DataFrame, new: DataFrame, key: Sequence[str], deletes: bool = True, last_by: Sequence[str] | None = None) -> DataFrame:
    """(op, key columns, changed, old, new) for each row to INSERT, DELETE or UPDATE.

    One null-safe full outer join on the key. A row changes if any column of `new` outside the key differs, nulls being equal;
    `changed` names these columns. Columns that only `old` has don't count; columns that only `new` has differ, even if null.
    Keys that repeat in `old`: the last by the columns `last_by` counts (without these, keys must be unique). Keys that repeat in `new` all count.
    """
    shared = [c for c in new.columns if c not in key]
    a, b = _sided(old, key, "o", last_by), _sided(new, key, "n", None)
    on = reduce(lambda x, y: x & y, (F.col(f"ok{i}").eqNullSafe(F.col(f"nk{i}")) for i in range(len(key))))
    j = a.join(b, on, "full_outer")
    had, has = F.col("o._there").isNotNull(), F.col("n._there").isNotNull()

    def change(c: str) -> Column:
        same = F.col("o")[c].eqNullSafe(F.col("n")[c]) if c in old.columns else F.lit(False)
        return F.when(~same, F.lit(c))

    changed = F.array_compact(F.array(*map(change, shared))) if shared else F.array().cast("array<string>")
    op = F.when(~had, "INSERT").when(~has, "DELETE").when(F.size(changed) > 0, "UPDATE")
    keys = [F.when(has, F.col(f"nk{i}")).otherwise(F.col(f"ok{i}")).alias(k) for i, k in enumerate(key)]
    out = j.select(op.alias("op"), *keys, F.when(had & has, changed).alias("changed"), F.when(had, F.col("o").dropFields("_there")).alias("old") if len(old.columns) > len(key) else F.lit(None).alias("old"), F.when(has, F.col("n").dropFields("_there")).alias("new") if shared else F.lit(None).alias("new"))
    return out.filter(F.col("op").isNotNull() if deletes else F.col("op").isin("INSERT", "UPDATE"))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def diff_tables(old: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, Sequence[str]], deletes: bool = True, fall_back: bool = False) -> DataFrame:
    """The changes of several tables in one long table: table_name, op, row_key (JSON), changed.

    Tables that can't be compared, as they have no key, are all reported in one error; with `fall_back` each of their new rows is an
    INSERT instead, with the whole row as row_key, and the other tables are compared as ever.
    """
    parts, errors = [], []
    for name in sorted(set(old) | set(new)):
        a, b = old.get(name), new.get(name)
        a, b = a if a is not None else b.limit(0), b if b is not None else a.limit(0)
        row = lambda columns: F.to_json(F.struct(*columns)).alias("row_key")
        try:
            key = key_of(name, b, keys.get(name))
            parts.append(diff(a, b, key, deletes).select(F.lit(name).alias("table_name"), "op", row(key), "changed"))
        except DiffError as e:
            if fall_back:
                parts.append(b.select(F.lit(name).alias("table_name"), F.lit("INSERT").alias("op"), row(b.columns), F.lit(None).cast("array<string>").alias("changed")))
            else:
                errors.append(str(e))
    if errors:
        raise DiffError("; ".join(errors))
    return reduce(DataFrame.unionByName, parts)


def apply_changes(old: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The new state: old, whose keys are unique, without the rows to delete and with those that changes insert or update. One full outer join; columns that a side lacks are null."""
    fields = changes.schema["new"].dataType
    others = [f.name for f in fields.fields] if isinstance(fields, T.StructType) else []
    kept = [c for c in old.columns if c not in key]
    a = old.select(*(F.col(k).alias(f"ok{i}") for i, k in enumerate(key)), F.struct(F.lit(True).alias("_there"), *kept).alias("o"))
    b = changes.select(*(F.col(k).alias(f"nk{i}") for i, k in enumerate(key)), "op", *(["new"] if others else []))
    on = reduce(lambda x, y: x & y, (F.col(f"ok{i}").eqNullSafe(F.col(f"nk{i}")) for i in range(len(key))))
    stays = F.col("op").isNull()
    keys = {k: F.when(stays, F.col(f"ok{i}")).otherwise(F.col(f"nk{i}")) for i, k in enumerate(key)}
    value = lambda c: F.when(stays, F.col("o")[c] if c in kept else F.lit(None)).otherwise(F.col("new")[c] if c in others else F.lit(None))
    j = a.join(b, on, "full_outer").filter(stays | (F.col("op") != "DELETE"))
    return j.select(*((keys[c] if c in keys else value(c)).alias(c) for c in [*old.columns, *(c for c in others if c not in old.columns)]))


def row_hash_compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one side has, by how often: (side, n_rows). Compared as whole rows, repeats counted, in one aggregation."""
    marked = lambda d, n: d.select(F.struct(*old.columns).alias("row"), F.lit(n).alias("n"))
    both = marked(old, 1).union(marked(new, -1)).groupBy("row").agg(F.sum("n").alias("n")).filter("n <> 0")
    return both.groupBy(F.when(F.col("n") > 0, "old").otherwise("new").alias("side")).agg(F.sum(F.abs("n")).alias("n_rows"))
