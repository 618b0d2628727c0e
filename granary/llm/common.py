"""What the operators of this subpackage share: reading tables, the shared folder, joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.scratch import scratch, shared_dir, stored  # noqa: F401

#: White space of the contracts: U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\f\r"
#: A word is a run of other characters (Java and Python spell this alike).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id where rows are keyed by id; sorts after all others.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; of the empty text for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, share: int = 1000) -> DataFrame:
    """Left join of `left` with `right`, which has one row for each `key`; `weight` says how many rows of `left` have it.

    Keys with at least 1/share of all rows are at most `share` rows of `right`: these are broadcast. Rows of
    `left` that they serve take `spread` as join key in the shuffled join that serves the rest, so that no task gets a hot key.
    `right` is read three times, so it should be a stored table. Columns of `right` must not occur in `left` apart from key.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    values = [c for c in right.columns if c not in (key, weight)]
    hot = right.filter(F.col(weight) * share >= F.lit(total)).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    rest = right.filter(F.col(weight) * share < F.lit(total)).select(F.col(key).alias("_rest_key"), F.struct(*values).alias("_rest"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_by", F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(spread))
    out = out.join(rest, (F.col("_by") == F.col("_rest_key")) & F.col("_hot_key").isNull(), "left")
    return out.select(*left.columns, *(F.coalesce(F.col("_hot")[c], F.col("_rest")[c]).alias(c) for c in values))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Python workers get whole texts in batches of `rows`, not of Spark's default of 10,000, which take ten times the memory; a setting of the user's own stays."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(rows))


def fresh(name: str, *dfs: DataFrame) -> str:
    """A column name that none of the tables has, whatever its case."""
    taken = {c.lower() for df in dfs for c in df.columns}
    out = f"_{name}"
    while out.lower() in taken:
        out += "_"
    return out


def others(df: DataFrame, names: Iterable[str]) -> list[str]:
    """df's columns but those with one of the names, in whatever case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def pieces_of(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Texts in order, in slices of about `most` bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield texts[at:i]
            at, held = i, 0
        held += size
    if len(texts) > at:
        yield texts[at:]
