"""Primary keys, unique and foreign keys, checks: held against data, while it is written."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.scratch import stored

#: Keys that repeat or that a foreign key refers to: broadcast up to this number, joined by shuffling beyond.
BROADCAST_KEYS = 1_000_000


class ConstraintError(ValueError):
    """Rows that break rules, and how many."""


@dataclass(frozen=True)
class Rule:
    """A rule by name. `kind` is PRIMARY KEY, UNIQUE, NOT NULL, CHECK or FOREIGN KEY; `columns` are its columns; `check` is a condition; `parent` and `parent_columns` are what a foreign key refers to."""

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    check: str | None = None
    parent: DataFrame | None = None
    parent_columns: tuple[str, ...] = ()


def _some_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def _small(keys: DataFrame) -> DataFrame:
    keys = stored(keys, "rule-keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def marked(df: DataFrame, rules: Sequence[Rule], broken: str = "broken") -> DataFrame:
    """df with an array of the names of the rules that each row breaks, in the order of rules.

    NOT NULL and CHECK look at the row alone; as in SQL a check that is null holds. UNIQUE holds where a column is null, PRIMARY KEY is unique and not null; all rows of a key that repeats break it. A foreign
    key holds where a column is null or the parent has the key. For keys that repeat the key columns alone are read and counted first, and only the repeated ones are joined
    to the rows (a broadcast, if they are few); so apart from these the rows are not shuffled. Rules of one name are errors.
    """
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ConstraintError("rules need different names")
    d, tests = df, []
    for i, r in enumerate(rules):
        if r.kind in ("PRIMARY KEY", "UNIQUE"):
            keys = [f"_k{i}_{j}" for j in range(len(r.columns))]
            twice = df.select(*(F.col(c).alias(k) for c, k in zip(r.columns, keys, strict=True))).na.drop().groupBy(*keys).count().filter("count > 1").select(*keys, F.lit(True).alias(f"_twice{i}"))
            d = d.join(_small(twice), [F.col(c) == F.col(k) for c, k in zip(r.columns, keys, strict=True)], "left").drop(*keys)
            test = F.coalesce(F.col(f"_twice{i}"), F.lit(False))
            tests.append(test | _some_null(r.columns) if r.kind == "PRIMARY KEY" else test)
        elif r.kind == "FOREIGN KEY":
            keys = [f"_p{i}_{j}" for j in range(len(r.columns))]
            known = r.parent.select(*(F.col(c).alias(k) for c, k in zip(r.parent_columns or r.columns, keys, strict=True))).na.drop().distinct().withColumn(f"_there{i}", F.lit(True))
            d = d.join(_small(known), [F.col(c) == F.col(k) for c, k in zip(r.columns, keys, strict=True)], "left").drop(*keys)
            tests.append(F.col(f"_there{i}").isNull() & ~_some_null(r.columns))
        elif r.kind == "NOT NULL":
            tests.append(_some_null(r.columns))
        elif r.kind == "CHECK" and r.check:
            tests.append(~F.coalesce(F.expr(r.check), F.lit(True)))
        else:
            raise ConstraintError(f"{r.name}: no such rule")
    found = F.array_compact(F.array(*(F.when(t, F.lit(n)) for t, n in zip(tests, names, strict=True)))) if rules else F.array().cast("array<string>")
    return d.select(*df.columns, found.alias(broken))


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, kind, n_rows) for each rule, 0 where all rows keep it. One aggregation of counts over the rows."""
    m = marked(df, rules, "_broken")
    counts = m.agg(*(F.count_if(F.array_contains("_broken", r.name)).alias(f"n{i}") for i, r in enumerate(rules)))
    rows = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.col(f"n{i}").alias("n_rows")) for i, r in enumerate(rules))))
    return counts.select(rows.alias("r")).select("r.*")


def write_checked(df: DataFrame, path: str, rules: Sequence[Rule], most: int | None = None) -> dict[str, int]:
    """Writes the rows that keep all rules to path/good, the others with `broken` to path/quarantine, and returns how many rows break each rule and, as "rows", how many there are.

    Both are written, and the numbers observed, in one pass over the rows (apart from the key columns that `marked` reads first). With `most` = 0 the first broken row ends the
    job; with a greater one the job runs through and more rows than that in quarantine are an error, after which both folders are there to look at. Both folders must be new.
    """
    m = marked(df, rules)
    if most == 0:
        stop = F.raise_error(F.concat(F.lit("broken: "), F.array_join("broken", ", "))).cast("array<string>")
        m = m.withColumn("broken", F.when(F.size("broken") > 0, stop).otherwise(F.col("broken")))
    seen = Observation()
    m = m.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("broken") > 0).alias("_bad"), *(F.count_if(F.array_contains("broken", r.name)).alias(r.name) for r in rules))
    folder = F.when(F.size("broken") > 0, "quarantine").otherwise("good")
    m.withColumn("_to", folder).write.partitionBy("_to").parquet(path)
    out = dict(seen.get)
    bad = out.pop("_bad")
    if most is not None and bad > most:
        raise ConstraintError(f"{bad} rows break rules: " + ", ".join(f"{n} {out[n]}" for n in (r.name for r in rules) if out[n]))
    return out


def read_checked(df: DataFrame, path: str, quarantine: bool = False) -> DataFrame:
    """What write_checked wrote of df: the rows that keep all rules, or with `quarantine` the others and the rules they break."""
    schema = T.StructType([*df.schema.fields, T.StructField("broken", T.ArrayType(T.StringType())), T.StructField("_to", T.StringType())])
    d = df.sparkSession.read.schema(schema).parquet(path).filter(F.col("_to") == ("quarantine" if quarantine else "good"))
    return d.select(*df.columns, *(["broken"] if quarantine else []))
