"""Schema differ: catalogs are tables (of tables, columns, constraints, indexes, comments), and their differences are full outer joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normal_name(name: Column, quoted: Column | None = None) -> Column:
    """Names compare without regard to case unless they are quoted."""
    return F.upper(name) if quoted is None else F.when(quoted, name).otherwise(F.upper(name))


def normal_type(kind: Column) -> Column:
    """One spelling for types that mean the same: TIMESTAMP(6) is TIMESTAMP, NUMBER(10) and NUMBER(10,0) are INTEGER, NUMBER(p,0) is NUMBER(p)."""
    k = F.regexp_replace(F.upper(F.trim(kind)), r"\s*([(),])\s*", "$1")
    k = F.regexp_replace(k, r"^TIMESTAMP\(6\)", "TIMESTAMP")
    k = F.regexp_replace(k, r"^NUMBER\(([0-9]+),0\)$", r"NUMBER($1)")
    return F.when(k == "NUMBER(10)", "INTEGER").otherwise(k)


def diff(old: DataFrame, new: DataFrame, key: Sequence[str], compare: Sequence[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """(op, key, change) for each key to ADD, DROP or MODIFY; `change` describes what differs, nulls being equal. With `within`, only where both sides have rows with these columns."""
    a, b = old.select(*key, F.struct(F.lit(1).alias("_one"), *compare).alias("_o")), new.select(*key, F.struct(F.lit(1).alias("_one"), *compare).alias("_n"))
    j = a.join(b, list(key), "full_outer")
    if within:  # a table's columns are a small group
        by = Window.partitionBy(*within)
        j = j.withColumns({"_a": F.max("_o._one").over(by), "_b": F.max("_n._one").over(by)}).filter("_a = 1 and _b = 1")
    text = lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))
    parts = [F.when(~F.col("_o")[c].eqNullSafe(F.col("_n")[c]), F.concat(F.lit(f"{c}: "), text(F.col("_o")[c]), F.lit(" -> "), text(F.col("_n")[c]))) for c in compare]
    change = F.concat_ws(", ", *parts) if parts else F.lit("")
    op = F.when(F.col("_o._one").isNull(), "ADD").when(F.col("_n._one").isNull(), "DROP").when(change != "", "MODIFY")
    return j.select(op.alias("op"), *key, F.when(op == "MODIFY", change).alias("change")).filter("op is not null")


def diff_tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogs with table_name: which tables come and go."""
    a, b = (x.select(normal_name(F.col("table_name")).alias("table_name")).distinct() for x in (old, new))
    return diff(a, b, ["table_name"]).drop("change")


def _columns(catalog: DataFrame) -> DataFrame:
    key = F.col("is_pk") if "is_pk" in catalog.columns else F.lit(False)
    return catalog.select(normal_name(F.col("table_name")).alias("table_name"), normal_name(F.col("column_name")).alias("column_name"), normal_type(F.col("sql_type")).alias("type"), (F.col("nullable") & ~key).alias("nullable"), F.trim("default_text").alias("default"))


def diff_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogs with table_name, column_name, sql_type, nullable, default_text and, if wanted, is_pk (which implies NOT NULL): columns added, dropped and modified in tables that both have."""
    return diff(_columns(old), _columns(new), ["table_name", "column_name"], ["type", "nullable", "default"], ["table_name"])


def diff_constraints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogs with table_name, kind, name and definition. Primary keys compare by table, with their names, of which those that a system made (SYS_C...) count as none; others compare by name, and unnamed ones aren't compared. What is modified is dropped and added."""
    def named(c: DataFrame) -> DataFrame:
        pk = F.col("kind") == "PRIMARY KEY"
        return c.filter(pk | F.col("name").isNotNull()).select(normal_name(F.col("table_name")).alias("table_name"), "kind", F.when(pk, F.lit("")).otherwise(normal_name(F.col("name"))).alias("name"), "definition", F.when(pk & ~F.upper("name").startswith("SYS_C"), F.upper("name")).alias("pk_name"))

    d = diff(named(old), named(new), ["table_name", "kind", "name"], ["definition", "pk_name"])
    ops = F.when(F.col("op") == "MODIFY", F.array(F.lit("DROP"), F.lit("ADD"))).otherwise(F.array("op"))
    return d.select(F.explode(ops).alias("op"), "table_name", "kind", "name")


def diff_indexes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogs with table_name, name, columns (text) and is_unique. Named indexes compare by name; unnamed ones by columns and uniqueness, under a generated name."""
    def keyed(c: DataFrame) -> DataFrame:
        made = F.concat(F.when(F.col("is_unique"), "uix_").otherwise("ix_"), F.lower("table_name"), F.lit("_"), F.replace(F.lower("columns"), F.lit(","), F.lit("_")))
        return c.select(normal_name(F.col("table_name")).alias("table_name"), F.coalesce(F.upper("name"), made).alias("name"), "columns", "is_unique")

    return diff(keyed(old), keyed(new), ["table_name", "name"], ["columns", "is_unique"])


def diff_comments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogs with table_name and comment: comments that differ, of tables that both have; nulls are equal."""
    a, b = (x.select(normal_name(F.col("table_name")).alias("table_name"), F.col("comment").alias(c)) for x, c in ((old, "old_comment"), (new, "new_comment")))
    return a.join(b, "table_name").filter(~F.col("old_comment").eqNullSafe(F.col("new_comment")))


def diff_column_comments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogs with table_name, column_name and comment: comments that differ, of columns that both have; nulls are equal."""
    names = [normal_name(F.col(c)).alias(c) for c in ("table_name", "column_name")]
    a, b = (x.select(*names, F.col("comment").alias(c)) for x, c in ((old, "old_comment"), (new, "new_comment")))
    return a.join(b, ["table_name", "column_name"]).filter(~F.col("old_comment").eqNullSafe(F.col("new_comment")))


# Options that a table has if nothing is said.
DEFAULT_OPTIONS = {"tablespace": "USERS", "pct_free": 10, "ini_trans": 1, "max_trans": 255, "logging": True, "cache": False, "row_movement": False}


def strip_default_options(options: DataFrame) -> DataFrame:
    """Null for options that have their default, so that they don't count as differences; columns are named as in DEFAULT_OPTIONS, others stay."""
    return options.withColumns({c: F.nullif(c, F.lit(v)) for c, v in DEFAULT_OPTIONS.items() if c in options.columns})


def derived_tables(catalog: DataFrame, flags: DataFrame, audit: Sequence[str] = ("aud_user", "aud_time")) -> DataFrame:
    """(table_name, column_name, source_table) of the tables derived from those of a catalog: <name>_AT has their columns and the audit columns; <name>_HT has their columns and is derived only where flags (table_name, flag) has Y."""
    base = catalog.select("table_name", "column_name")
    history = base.join(flags.filter("flag = 'Y'").select("table_name").distinct(), "table_name", "left_semi").withColumn("suffix", F.lit("_HT"))
    more = base.select("table_name").distinct().select("table_name", F.explode(F.array(*map(F.lit, audit))).alias("column_name"))
    every = base.union(more).withColumn("suffix", F.lit("_AT")).unionByName(history)
    return every.select(F.concat("table_name", "suffix").alias("table_name"), "column_name", F.col("table_name").alias("source_table"))


def column_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each table with differing columns, the list of these with what differs, in order of their names."""
    d = diff_columns(old, new)
    item = F.concat_ws(" ", "op", "column_name", "change")
    return d.groupBy("table_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(item)), "; ").alias("differences"))


# Which operation takes another back; others can't be taken back without loss.
REVERSE = {"CREATE TABLE": "DROP TABLE", "ADD COLUMN": "DROP COLUMN", "ADD CONSTRAINT": "DROP CONSTRAINT", "CREATE INDEX": "DROP INDEX", "RENAME COLUMN": "RENAME COLUMN"}


def migration_steps(changes: DataFrame, what: str) -> DataFrame:
    """changes (op, ...) of a kind of object with the step's operation and the one that takes it back, null if none does."""
    verb = F.when(F.col("op") == "ADD", "CREATE" if what in ("TABLE", "INDEX") else "ADD").otherwise(F.col("op"))
    step = F.concat(verb, F.lit(f" {what}"))
    return changes.withColumns({"step": step, "reverse": F.element_at(F.create_map(*(F.lit(x) for k in REVERSE.items() for x in k)), step)})


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The columns of DataFrames as a catalog: table_name, pos, column_name, sql_type, nullable, default_text. Only schemas are read."""
    rows = [(t, i, f.name, str(f.metadata.get("sql_type", f.dataType.simpleString().upper())), f.nullable, f.metadata.get("default")) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, pos int, column_name string, sql_type string, nullable boolean, default_text string")


# Names of types in Spark, by their names in SQL dialects.
TYPES = {
    "VARCHAR": "string", "VARCHAR2": "string", "NVARCHAR2": "string", "CHAR": "string", "NCHAR": "string", "TEXT": "string", "CLOB": "string", "LONG": "string", "XMLTYPE": "string", "UUID": "string", "INET": "string", "CIDR": "string", "ROWID": "string",
    "INTEGER": "int", "INT": "int", "SERIAL": "int", "BIGINT": "bigint", "BIGSERIAL": "bigint", "SMALLINT": "smallint", "SMALLSERIAL": "smallint",
    "REAL": "float", "FLOAT": "float", "BINARY_FLOAT": "float", "DOUBLE": "double", "DOUBLE PRECISION": "double", "BINARY_DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "BLOB": "binary", "BYTEA": "binary", "RAW": "binary", "JSON": "variant", "JSONB": "variant", "MONEY": "decimal(19,2)",
}


def spark_type(sql_type: str) -> str:
    """The Spark type for a type of SQL: decimals keep precision and scale (NUMBER alone is decimal(38,10), DECIMAL alone decimal(18,0)); T[] is an array; an unknown type is an error."""
    text = " ".join(sql_type.upper().split())
    if text.endswith("[]"):
        return f"array<{spark_type(text[:-2])}>"
    name, _, inner = text.partition("(")
    inner, _, after = inner.partition(")")
    name = f"{name.strip()} {after.strip()}".strip()
    if name in ("NUMBER", "DECIMAL", "NUMERIC"):
        p, _, s = inner.partition(",")
        if not p.strip():
            return "decimal(38,10)" if name == "NUMBER" else "decimal(18,0)"
        return f"decimal({38 if p.strip() == '*' else int(p)},{int(s or 0)})"
    if name not in TYPES:
        raise ValueError(f"unknown type {sql_type}")
    return TYPES[name]


def read_as(df: DataFrame, catalog: Sequence[tuple[str, str]]) -> DataFrame:
    """df's columns cast to the types that a catalog (column, SQL type) gives them."""
    return df.select(*(F.col(c).cast(spark_type(t)).alias(c) for c, t in catalog))


def splice_columns(columns: DataFrame, inserted: Sequence[tuple[str, str]], before: str, suffix: str = "_AT") -> DataFrame:
    """(table_name, position, column_name, sql_type) of a derived table for each table of columns (table_name, position, column_name, sql_type): the inserted columns
    (name, type) stand, in their order, right before the column named `before`, or at the end where there is none; columns that are called like an inserted one go from
    their old places; positions are numbered anew from 1. Names are compared without regard to case.

    Places are numbers to sort by: a base column has its position, inserted ones half a step before. One window over a table's columns numbers them.
    """
    names = [n.upper() for n, _ in inserted]
    base = columns.filter(~F.upper("column_name").isin(names)).select("table_name", F.col("position").cast("double").alias("_at"), F.lit(0).alias("_nth"), "column_name", "sql_type")
    place = F.coalesce(F.min(F.when(F.upper("column_name") == before.upper(), F.col("position"))) - 0.5, F.max("position") + 0.5)
    tables = columns.groupBy("table_name").agg(place.alias("_at"))
    rows = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("_nth"), F.lit(n).alias("column_name"), F.lit(t).alias("sql_type")) for i, (n, t) in enumerate(inserted))))
    more = tables.withColumn("_c", rows).select("table_name", "_at", "_c.*")
    order = Window.partitionBy("table_name").orderBy("_at", "_nth")
    d = base.unionByName(more).withColumn("position", F.row_number().over(order).cast("long"))
    return d.select(F.concat("table_name", F.lit(suffix)).alias("table_name"), "position", "column_name", "sql_type")
