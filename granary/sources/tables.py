"""Reading tables, files of statements and database tables; inline rows and the one-row table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.dumps import numbered, split_statements


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_row(spark: SparkSession) -> DataFrame:
    """What a SELECT without FROM, or from DUAL, reads: one row."""
    return spark.range(1).select(F.lit("X").alias("dummy"))


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Inline rows, typed by the schema."""
    return spark.createDataFrame(rows, schema)


def jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, fetch: int = 1000, **options: str) -> DataFrame:
    """A database table, read in `parts` ranges of a numeric column if one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize=str(fetch), **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


# What URLs of databases begin with.
DIALECTS = {"jdbc:oracle:": "oracle", "jdbc:postgresql:": "postgres"}


def dialect_of(url: str) -> str:
    """The dialect that a JDBC URL tells; ansi for others."""
    return next((d for start, d in DIALECTS.items() if url.lower().startswith(start)), "ansi")


def glob_to_regex(glob: str) -> str:
    """** is any path, * any name, ? any character but a slash; the rest is plain."""
    parts = {"**": "(.+)", "*": "([^/]+)", "?": "[^/]"}
    return "^" + "".join(parts.get(x) or re.escape(x) for x in re.findall(r"\*\*|\*|\?|[^*?]+", glob)) + "$"


def like_to_regex(pattern: str) -> str:
    """A LIKE pattern as a regular expression that ignores case."""
    return "(?i)^" + "".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in pattern) + "$"


def statement_files(spark: SparkSession, path: str, glob: str = "*.sql") -> DataFrame:
    """(file, pos, text) of the statements in files: what stands between semicolons that are in no quotes and no comment, without its comments. See dumps.split_statements, which reads large files in ranges."""
    return numbered(split_statements(spark, path, glob, comments=False)).select("file", "pos", "text")
