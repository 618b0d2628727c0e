"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: each node with the smallest that they connect it with."""
    up: dict = {}
    schema = None

    def top(x: object) -> object:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    nodes = [x for x in up if top(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(0).type) for c in (nodes, [top(x) for x in nodes])], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b): the smallest node that it is connected with.

    First each partition's edges become stars to the smallest node that they connect, which shortens most paths. Then two steps alternate
    until nothing changes: each edge is replaced by one from its larger end to the smallest
    neighbour of its smaller end (large star), then each node's smaller neighbours are linked to the smallest of them (small star).
    The number of rounds grows with the logarithm of the longest path. Each round is stored in the shared folder. Only minima are aggregated
    by node, so a node with very many edges is no large group. Loops and repeated edges do no harm; no edges give no rows.
    """
    facts = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit("again")))).first())
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").repartition("b")
    e = stored(e.mapInArrow(_stars, e.schema).distinct(), "edges")
    known = facts(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = large.union(e.join(least, F.col("a") == F.col("u")).filter("a <> m").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = stored(small, "edges")
        e, before, known = new, known, facts(new)
        if known == before:  # the same edges, by their number and 128 bits of hashes
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
