"""Mixing sources to target weights: each source gives exactly its share of words, repeating documents where it must."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, stored


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes (source, source_size) with each source's target.

    The sources, by code point and null last, take `weights` in turn and share `share` times all words by them; no target
    exceeds `most` times its source's size, and what is above goes to the others by weight. That is filling to one level:
    the targets are least(cap, level * weight), and in order of cap / weight the level follows from running sums.
    The windows run over one row a source, never over documents.
    """
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * most)
    s = s.withColumn("_at", F.col("_cap") / F.col("_w"))
    by_cap = Window.orderBy("_at", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "_rank": F.row_number().over(by_cap),
        "_left": F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_open": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
    })
    s = s.withColumn("_level", F.col("_left") / F.col("_open"))
    first = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_rank", "_level"))).over(everything)
    level = F.coalesce(first["_level"], F.max("_at").over(everything))
    return s.select("source", "source_size", F.least(F.col("_cap").cast("double"), level * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row of docs: doc_id, source, size, source_size, target and the words `taken`.

    Each document gets a hash-random key (md5 of its id). A source takes whole epochs of all its documents and then, in order
    of the keys, documents up to its exact budget; the one at the cut gives part of its words. Prefix sums are taken in two
    levels, so that a source of any size is spread over tasks: 4096 ranges of the key for each source get running sums, and
    documents get theirs within a range.

    A null text has size 0. A null source is a source of its own, the last. Rows that repeat an id count as they are; equal
    rows may swap places. An empty table gives an empty result. Other columns of docs are not looked at.
    """
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_key"))
    light = stored(light, "mix-sizes").withColumn("_range", F.substring("_key", 1, 3))
    ranges = light.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = targets.withColumnRenamed("source", "_source")
    ranges = ranges.join(t, F.col("source").eqNullSafe(F.col("_source")), "inner").select("source", F.col("_range").alias("_r"), "_before", "source_size", "target").withColumnRenamed("source", "_s")
    out = light.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")), "inner")
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
