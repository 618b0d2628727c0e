"""JSON of unknown shape as data: parsed to variants, looked through at any depth, cut to columns by type, and written back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.scratch import stored


def parsed(df: DataFrame, column: str, into: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows with the JSON text parsed as a variant `into`, rows whose text is no JSON). Null texts are in the first, as null."""
    v = F.try_parse_json(column)
    bad = F.col(column).isNotNull() & F.col("_parsed").isNull()
    d = df.withColumn("_parsed", v)
    return d.filter(~bad).withColumn(into, F.col("_parsed")).drop("_parsed"), d.filter(bad).drop("_parsed")


def descend(df: DataFrame, column: str, deepest: int = 64) -> DataFrame:
    """df's rows with (depth, path, key, kind, scalar, node) for each value within the variant column, however deep: path is `$`, then `.key` and `[position]`; kind is the value's type; scalar is its text, null for objects, arrays and nulls.

    A level at a time: objects and arrays of a level are exploded to the next, until there are none; no level holds more than the values of its depth. Rows without a value give none. Deeper than
    `deepest` is an error, not a cut.
    """
    names = [c for c in df.columns if c != column]
    kind = F.when(F.is_variant_null("node"), "NULL").otherwise(F.regexp_extract(F.schema_of_variant("node"), r"^(\w+)", 1))
    told = lambda d: d.withColumn("kind", kind).withColumn("scalar", F.when(~F.col("kind").isin("OBJECT", "ARRAY", "NULL", "VOID"), F.try_variant_get("node", "$", "string")))
    level = told(df.filter(F.col(column).isNotNull()).select(*names, F.lit(0).alias("depth"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.col(column).alias("node")))
    level = stored(level, "level")
    out = [level]
    spark = df.sparkSession
    for depth in range(1, deepest + 2):
        inner = level.filter(F.col("kind").isin("OBJECT", "ARRAY"))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, out)
        if depth > deepest:
            raise ValueError(f"values lie deeper than {deepest}")
        e = inner.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        path = F.concat("path", F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), "_key")).otherwise(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))))
        level = stored(told(e.select(*names, F.lit(depth).alias("depth"), path.alias("path"), F.col("_key").alias("key"), F.col("_value").alias("node"))), "level")
        out.append(level)
    raise AssertionError("unreachable")


def shredded(df: DataFrame, column: str, type_path: str, shapes: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """For each type a table of its own: rows whose variant has this type at type_path, with columns (name: (path and SQL type, as `$.a.b int`)) instead of the variant. What a path does not lead to, or is of another type, is null. Rows of other types are in the table named by the empty text, as they are."""
    found = F.try_variant_get(column, type_path, "string")
    rest = [c for c in df.columns if c != column]
    out = {"": df.filter(found.isNull() | ~found.isin(*shapes))}
    for name, columns in shapes.items():
        made = [F.try_variant_get(column, *spec.rsplit(" ", 1)).alias(c) for c, spec in columns.items()]
        out[name] = df.filter(found == name).select(*rest, *made)
    return out


def written(df: DataFrame, column: str) -> DataFrame:
    """df with the variant column as JSON text again; what was parsed and written is equal up to blanks and the order of keys."""
    return df.withColumn(column, F.to_json(column))
