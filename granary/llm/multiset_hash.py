"""Fingerprints of documents as sums: each paragraph is hashed to a wide vector, and a text is the sum of its paragraphs' vectors."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fresh, others, pieces_of, small_batches, stored
from granary.llm.shingles import each_words, mix

#: Lanes of 64 bits, random for each paragraph, for equality; and lanes of 32 bits, to which each shingle of a paragraph adds 1 or -1, for likeness.
WIDE, LANES = 8, 256
SIZE = 8 * WIDE + 4 * LANES
#: Words of a shingle.
SHINGLE = 3
#: Bytes of texts that are summed together, bytes of texts in a range of the sorted table, and ranges at most (their bounds pass the driver; beyond, ranges are larger).
BATCH, RANGE_BYTES, MOST_RANGES = 1 << 23, 1 << 24, 500_000
_BYTES = bytes(range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROW = "doc_id long, n_chars long, edited_text string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


class Sums:
    """The fingerprints of several texts. They add and subtract lane by lane, modulo 2^64 and 2^32, so paragraphs can come and go in any order."""

    def __init__(self, wide: np.ndarray, lanes: np.ndarray) -> None:
        self.wide, self.lanes = wide, lanes

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.wide + other.wide, self.lanes + other.lanes)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.wide - other.wide, self.lanes - other.lanes)

    def __getitem__(self, rows: slice) -> Sums:
        return Sums(self.wide[rows], self.lanes[rows])

    def to_bytes(self) -> list[bytes]:
        return [w.tobytes() + n.tobytes() for w, n in zip(self.wide.astype("<u8"), self.lanes.astype("<u4"), strict=True)]

    @staticmethod
    def from_bytes(rows: Sequence[bytes]) -> Sums:
        data = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), SIZE)
        return Sums(np.ascontiguousarray(data[:, : 8 * WIDE]).view("<u8"), np.ascontiguousarray(data[:, 8 * WIDE :]).view("<u4"))

    def likeness(self, other: Sums) -> np.ndarray:
        """From 0 to 1: 1 for equal fingerprints, else the cosine of the lanes, which estimates that of the shingle counts within about 1/sqrt(LANES)."""
        a, b = (x.lanes.astype(np.int32).astype(np.float64) for x in (self, other))
        size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        cosine = np.divide((a * b).sum(axis=1), size, out=np.zeros(len(size)), where=size > 0)
        same = (self.wide == other.wide).all(axis=1) & (self.lanes == other.lanes).all(axis=1)
        return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def _shingles(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the shingles of each line; one of all its words where it has fewer."""
    hashes, lines = [], []
    first = np.flatnonzero(np.diff(line, prepend=-1) != 0) if len(line) else np.zeros(0, np.int64)
    sizes = np.diff(first, append=len(line))
    h = np.zeros(len(words), np.uint64)
    for k in range(1, SHINGLE + 1):
        h[: len(words) - k + 1] = mix(h[: len(words) - k + 1] * _ODD + words[k - 1 :])
        at = first[sizes == k] if k < SHINGLE else np.flatnonzero(line[: len(line) - k + 1] == line[k - 1 :])
        hashes.append(h[at] + np.uint64(k))
        lines.append(line[at])
    return mix(np.concatenate(hashes)), np.concatenate(lines)


def sums(texts: Sequence[str]) -> Sums:
    """The fingerprints of texts: the sums over their paragraphs, which are the lines that aren't empty. Each text costs its length once."""
    split = [t.split("\n") if t else [] for t in texts]
    text_of = np.repeat(np.arange(len(texts)), [len(x) for x in split])
    lines = [x for ls in split for x in ls]
    full = np.array([bool(x) for x in lines], bool)
    lines, text_of = [x for x in lines if x], text_of[full]
    wide, lanes = np.zeros((len(texts), WIDE), np.uint64), np.zeros((len(texts), LANES), np.uint32)
    if lines:
        digests = b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8 * WIDE).digest() for x in lines)
        first = np.flatnonzero(np.diff(text_of, prepend=-1))
        wide[text_of[first]] = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, WIDE), first, axis=0)
        words = list(each_words(pa.array(lines, pa.large_string()), _BYTES))
        h, line = _shingles(np.concatenate(words), np.repeat(np.arange(len(lines)), [len(w) for w in words]))
        place = text_of[line] * LANES + (h % np.uint64(LANES)).astype(np.int64)
        total = np.bincount(place, weights=1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64), minlength=lanes.size)
        lanes = total.astype(np.int64).astype(np.uint32).reshape(lanes.shape)
    return Sums(wide, lanes)


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `fingerprint`, SIZE bytes: the same for texts with the same paragraphs in any order, and else, but for chance in 512 bits, another.

    One map over the table. The hash resists chance, not an adversary: it has no key. Null and empty texts, and those of line ends alone, have the sum of nothing.
    Very long texts are summed whole; ties and repeated rows have equal fingerprints; an empty table gives an empty result. A column called fingerprint is replaced, others stay.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([x for part in pieces_of(texts, BATCH) for x in sums([t or "" for t in part.to_pylist()]).to_bytes()], pa.binary())

    at = fresh("sum", docs)
    d = docs.withColumn(at, made(F.col(text_col)))
    return d.select(*others(docs, ("fingerprint",)), F.col(at).alias("fingerprint"))


def changed(before: Column, inserted: Column, deleted: Column) -> Column:
    """The fingerprint of a text whose fingerprint is `before`, after paragraphs of `inserted` came and those of `deleted` went: the rest of the text isn't needed. Null texts are empty; a null fingerprint stays null."""

    @F.arrow_udf("binary")
    def made(old: pa.Array, more: pa.Array, less: pa.Array) -> pa.Array:
        rows = [(o, a or "", b or "") for o, a, b in zip(old.to_pylist(), more.to_pylist(), less.to_pylist(), strict=True) if o is not None]
        new = iter((Sums.from_bytes([r[0] for r in rows]) + sums([r[1] for r in rows]) - sums([r[2] for r in rows])).to_bytes() if rows else [])
        return pa.array([None if o is None else next(new) for o in old.to_pylist()], pa.binary())

    return made(before, inserted, deleted)


def likeness(a: Column, b: Column) -> Column:
    """See Sums.likeness; null where a fingerprint is null."""

    @F.arrow_udf("double")
    def made(x: pa.Array, y: pa.Array) -> pa.Array:
        there = [None not in p for p in zip(x.to_pylist(), y.to_pylist(), strict=True)]
        rows = [p for p, t in zip(zip(x.to_pylist(), y.to_pylist(), strict=True), there, strict=True) if t]
        near = iter(Sums.from_bytes([r[0] for r in rows]).likeness(Sums.from_bytes([r[1] for r in rows])).tolist() if rows else [])
        return pa.array([next(near) if t else None for t in there], pa.float64())

    return made(a, b)


def edit(text: str, following: str) -> tuple[str, str, str]:
    """(edited text, paragraphs that went, paragraphs that came): the last half of the code points is replaced by the first as many of another text, or all of it."""
    half = len(text) // 2
    cut = len(text) - half
    out = text[:cut] + following[:half]
    line = text.rfind("\n", 0, cut) + 1
    return out, text[line:], out[line:]


def compare(texts: list[str], following: list[str]) -> tuple[list[str], Sums, Sums, np.ndarray, np.ndarray]:
    """Edited texts, the fingerprints of texts and of edited ones, and what these and those of the following texts are like. following[i] is texts[i + 1] but for the last, whose fingerprint is made once more."""
    edited, less, more = zip(*(edit(t, f) for t, f in zip(texts, following, strict=True)), strict=True)
    own = sums([*texts, following[-1]])
    new = own[:-1] - sums(less) + sums(more)
    return list(edited), own[:-1], new, own[:-1].likeness(new), own[:-1].likeness(own[1:])


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The order: id descending, null last, then a hash of the text; rows that are equal in both are told apart by a number that may be any. `none`, `down`, `hash` and `salt` sort ascending."""
    id_ = F.col(id_col).cast("long")
    d = docs.select(id_.alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    return d.select(F.col("doc_id").isNull().cast("int").alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("down"), F.xxhash64("text").alias("hash"), "salt", "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row doc_id, n_chars, edited_text (see `edit`, by the next row in the order of descending id, after the last the first), its fingerprint and that of the edited
    text, near_edited and near_next: what its fingerprint is like that of the edited text, and of the next row's text.

    Whole texts are shuffled once: rows are dealt to ranges of about RANGE_BYTES by keys whose bounds Spark's range partitioning found, and each range
    gets a copy of the row after its last, the first of the next range. Within a range rows stream by, so a task holds a batch. The edited text's
    fingerprint comes from the text's own by taking the paragraphs from the cut on away and adding the new ones.

    Null texts are empty; null ids come last; rows with one id are ordered by a hash of their text, and repeated rows, which are
    equal to each other, may lie in several ranges. Very long texts stay whole. A single row is followed by itself. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    order = ("none", "down", "hash", "salt")
    rows = _keys(docs, id_col, text_col)
    keys = stored(rows.select(*order, F.octet_length("text").cast("long").alias("size")), "order-keys")
    n, size = keys.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return spark.createDataFrame([], _ROW)
    ranges = min(n, MOST_RANGES, max(-(-size // RANGE_BYTES), 2 * spark.sparkContext.defaultParallelism))
    least = keys.repartitionByRange(ranges, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("low"))
    bounds = sorted(tuple(r.low) for r in least.collect())  # one a range
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def range_of(none: pa.Array, down: pa.Array, hash_: pa.Array, salt: pa.Array) -> pa.Array:
        return pa.array([max(bisect_right(shared.value, k) - 1, 0) for k in zip(*(x.to_pylist() for x in (none, down, hash_, salt)), strict=True)], pa.int32())

    heads = spark.createDataFrame([(i, *b[:3]) for i, b in enumerate(bounds)], "next int, n_ int, d_ long, h_ long")
    follow = rows.join(F.broadcast(heads), (F.col("none") == F.col("n_")) & (F.col("down") == F.col("d_")) & (F.col("hash") == F.col("h_"))).dropDuplicates(["next"])
    last = F.lit(True)
    follow = follow.select(F.pmod(F.col("next") - 1, F.lit(len(bounds))).alias("range"), last.alias("guard"), *rows.columns)
    dealt = rows.select(range_of(*order).alias("range"), F.lit(False).alias("guard"), *rows.columns).unionByName(follow)
    dealt = dealt.repartitionById(len(bounds), F.col("range")).sortWithinPartitions("range", "guard", *order).select("range", "guard", "doc_id", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []  # the row before, if its range goes on
        for b in batches:
            at = 0
            for part in pieces_of(b.column(3), BATCH):
                stops = b.column(1)[at : at + len(part)].to_pylist()
                ids = b.column(2)[at : at + len(part)].to_pylist()
                at += len(part)
                for row in zip(ids, part.to_pylist(), stops, strict=True):
                    held.append(row[:2])
                    if row[2]:
                        yield from out(held)
                        held = []
                yield from out(held)
                held = held[-1:]

    def out(held: list[tuple[int | None, str]]) -> Iterator[pa.RecordBatch]:
        """Results for all rows but the last, which follows them."""
        if len(held) > 1:
            texts = [t for _, t in held]
            edited, own, new, near_edited, near_next = compare(texts[:-1], texts[1:])
            columns = [pa.array([i for i, _ in held[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(edited), pa.array(own.to_bytes(), pa.binary()), pa.array(new.to_bytes(), pa.binary()), pa.array(near_edited), pa.array(near_next)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ROW.split(", ")])

    return dealt.mapInArrow(compared, _ROW)
