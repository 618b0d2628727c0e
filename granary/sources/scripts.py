"""Ordered scripts, one for each schema, in numbered files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what stands between changes of structure and changes of data.
DIVIDER = "-- Data Changes"


def write_scripts(statements: DataFrame, path: str, data_from: int, parts: int | None = None) -> None:
    """Writes statements (schema, priority, pos, statement) to a folder for each schema, in the order of priority and pos.

    Rows are partitioned by ranges of (schema, priority, pos) and sorted there, and Spark numbers files by partition: a schema's files, by name, are its
    script, and a schema of any size is spread over as many as its ranges. In a schema that has both, DIVIDER stands before the first statement whose priority is at
    least `data_from`. Statements may have several lines; a null schema is Spark's folder for null. An empty table gives an empty folder.
    """
    kinds = statements.groupBy("schema").agg(F.min(F.col("priority") < data_from).alias("_a"), F.max(F.col("priority") < data_from).alias("_b"))
    rows = statements.select("schema", F.col("priority").cast("int").alias("_priority"), F.col("pos").cast("long").alias("_pos"), F.lit(1).alias("_kind"), "statement")
    divider = kinds.filter("_a <> _b").select("schema", F.lit(data_from).alias("_priority"), F.lit(None).cast("long").alias("_pos"), F.lit(0).alias("_kind"), F.lit(DIVIDER).alias("statement"))
    order = [F.col("schema"), F.when(F.col("_kind") == 0, F.lit(data_from - 0.5)).otherwise(F.col("_priority")), F.col("_pos")]
    d = rows.unionByName(divider).select("schema", order[1].alias("_at"), "_pos", "statement")
    by = ("schema", "_at", "_pos")
    d = d.repartitionByRange(parts, *by) if parts else d.repartitionByRange(*by)
    d.sortWithinPartitions(*by).select("schema", "statement").write.partitionBy("schema").text(path)


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(schema, file, line, text): the lines of scripts; ordered by file and line they are a schema's script. Line numbers only order the lines of a file."""
    d = spark.read.text(path)
    return d.select("schema", F.col("_metadata.file_name").alias("file"), (F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id() % (1 << 33)).alias("line"), F.col("value").alias("text"))
