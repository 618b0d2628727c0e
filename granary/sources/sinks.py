"""Writing tables as INSERT statements and JSON, and results by key."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(column: Column, kind: T.DataType, dialect: str = "ansi") -> Column:
    """A value as text of SQL: NULL, numbers plain, dates and times typed, bytes in hex, the rest quoted."""
    if isinstance(kind, (T.NumericType,)):
        text = column.cast("string")
    elif isinstance(kind, T.BooleanType):
        text = column.cast("int").cast("string") if dialect == "oracle" else F.upper(column.cast("string"))
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit("DATE '"), column.cast("string"), F.lit("'"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        plain = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        text = F.concat(F.lit("TO_TIMESTAMP('"), plain, F.lit("', 'YYYY-MM-DD HH24:MI:SS.FF6')")) if dialect == "oracle" else F.concat(F.lit("TIMESTAMP '"), plain, F.lit("'"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("HEXTORAW('"), F.hex(column), F.lit("')")) if dialect == "oracle" else F.concat(F.lit("'\\x"), F.lower(F.hex(column)), F.lit("'"))
        text = F.concat(text, F.lit("::bytea")) if dialect == "postgres" else text
    else:
        text = F.concat(F.lit("'"), F.replace(column.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_batches(df: DataFrame, name: str, order: Sequence[str], size: int = 1000, dialect: str = "ansi", part_rows: int = 100_000) -> DataFrame:
    """(part, batch, n_rows, statement): INSERT statements of at most `size` rows.

    Rows are counted and dealt to parts of about `part_rows` by a hash of the order columns, and numbered within a part, so that what a task sorts doesn't grow with the table.
    """
    spread = -(-df.count() // part_rows) or 1
    columns = [c for c in df.columns]
    row = F.concat(F.lit("("), F.concat_ws(", ", *(literal(F.col(f.name), f.dataType, dialect) for f in df.schema.fields)), F.lit(")"))
    d = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int")).withColumn("_row", row)
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_row")) - 1)
    g = d.groupBy(F.col("_part").alias("part"), F.floor(F.col("_n") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("_n", "_row"))).alias("_rows"))
    text = F.concat(F.lit(f"INSERT INTO {name} ({', '.join(columns)}) VALUES\n"), F.array_join(F.transform("_rows", lambda x: x["_row"]), ",\n"), F.lit(";"))
    return g.select("part", "batch", F.size("_rows").cast("long").alias("n_rows"), text.alias("statement"))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row, without null fields."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def json_dump(df: DataFrame, schema: str, name: str) -> DataFrame:
    """A table as JSON texts, line by line: first the header (schema, table, columns), then its rows."""
    head = json.dumps({"schema": schema, "table": name, "columns": df.columns})
    return df.sparkSession.range(1).select(F.lit(head).alias("json")).union(json_rows(df))


def write_by_key(df: DataFrame, path: str, key: str, form: str = "json") -> None:
    """Fan-out: a folder for each value of the key."""
    df.write.partitionBy(key).format(form).save(path)


def change_statements(changes: DataFrame, name: str, key: Sequence[str], dialect: str = "ansi") -> DataFrame:
    """(op, key columns, statement): an INSERT, UPDATE or DELETE for each row of what rowdiff.diff gives. Updates set the changed columns."""
    kinds = dict(zip(changes.columns, (f.dataType for f in changes.schema.fields), strict=True))
    fields = kinds["new"].fields if isinstance(kinds["new"], T.StructType) else []
    value = lambda f: literal(F.col("new")[f.name], f.dataType, dialect)
    at = [F.when(F.col(k).isNull(), f"{k} IS NULL").otherwise(F.concat(F.lit(f"{k} = "), literal(F.col(k), kinds[k], dialect))) for k in key]
    where = F.concat(F.lit(" WHERE "), F.concat_ws(" AND ", *at))
    names, row = [*key, *(f.name for f in fields)], [*(literal(F.col(k), kinds[k], dialect) for k in key), *map(value, fields)]
    put = F.concat(F.lit(f"INSERT INTO {name} ({', '.join(names)}) VALUES ("), F.concat_ws(", ", *row), F.lit(")"))
    sets = F.concat_ws(", ", *(F.when(F.array_contains("changed", f.name), F.concat(F.lit(f"{f.name} = "), value(f))) for f in fields))
    text = F.when(F.col("op") == "INSERT", put).when(F.col("op") == "DELETE", F.concat(F.lit(f"DELETE FROM {name}"), where)).otherwise(F.concat(F.lit(f"UPDATE {name} SET "), sets, where))
    return changes.select("op", *key, F.concat(text, F.lit(";")).alias("statement"))

