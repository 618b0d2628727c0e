"""Line dedup: lines that several documents share stay only in the document with the smallest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import NO_ID, WHITE, ascii_lower, lookup, others, stored


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key_hash(line: Column, min_chars: int) -> Column:
    key = ascii_lower(F.btrim(line, F.lit(WHITE)))
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's repeated lines dropped, and n_lines (before) and n_dropped.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least `min_chars` code points
    found in at least `min_docs` documents lose their lines everywhere but in the document with the smallest id.
    The lines are exploded, keyed by a 128-bit hash and counted; only hashes and positions are shuffled for that. The
    positions to drop then meet the text once, and what stays is joined by position.

    A null or empty text is one empty line. Rows that share an id are one document. A null id is a document of its own
    that comes after all others. Very long texts and lines count whole; equal keys within a document make no tie, since a document keeps or loses all its
    lines of a key; an empty table gives an empty result. Columns called n_lines or n_dropped in docs are replaced, others stay.
    """
    keep = [c for c in others(docs, ("n_lines", "n_dropped")) if c.lower() != text_col.lower()]
    name = next(c for c in docs.columns if c.lower() == text_col.lower())
    d = docs.select(F.struct(F.lit(1).alias("one"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))).alias("row"), F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    d = d.withColumn("hash", F.xxhash64("text"))
    keyed = d.select("id", "hash", F.posexplode(F.transform(_lines(F.col("text")), lambda x: _key_hash(x, min_chars))).alias("pos", "key")).filter(F.col("key").isNotNull())
    once = keyed.groupBy("key", "id").agg(F.count("*").alias("n"))
    seen = once.groupBy("key").agg(F.count("*").alias("docs"), F.min("id").alias("keeper"), F.sum("n").alias("weight"))
    seen = stored(seen.filter(F.col("docs") >= min_docs).drop("docs"), "line-keys")
    found = lookup(keyed, seen, "key", "weight", F.unhex(F.md5(F.concat_ws(":", "id", "pos"))))
    drops = found.filter(F.col("keeper").isNotNull() & (F.col("keeper") != F.col("id"))).groupBy("id", "hash").agg(F.collect_set("pos").alias("drops"))
    # Texts without a line to lose meet nothing, so these need not be one join key.
    d = d.withColumn("id", F.when(F.length(F.coalesce("text", F.lit(""))) < min_chars, -1 - F.pmod(F.monotonically_increasing_id(), F.lit(100_003))).otherwise(F.col("id")))
    d = d.join(drops, ["id", "hash"], "left").withColumn("lines", _lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    dropped = F.when(F.col("drops").isNull(), F.lit(0)).otherwise(F.size("drops"))
    at = {c: f"row.c{i}" for i, c in enumerate(keep)}
    old = [text.alias(c) if c == name else F.col(at[c]).alias(c) for c in docs.columns if c == name or c in at]
    return d.select(*old, F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
