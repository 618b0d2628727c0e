"""N-gram Jaccard join with signature trees: exact components of documents whose shingle sets are alike."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import lookup, small_batches, stored
from granary.llm.components import components
from granary.llm.shingles import each_set

#: Bits of the smallest and the largest bitmaps; between these they have at least twice as many bits as the set has shingles.
BITS, MOST_BITS = 1 << 10, 1 << 20
FAN = 8
#: Pairs of nodes that a traversal looks at in one go.
PIECE = 4000
#: Rows of a block that one task compares; larger blocks are dealt in tiles of this size. Bytes of bitmaps that a task gathers before it compares what is complete.
TILE, HELD_BYTES = 256, 16_000_000
#: Ids in this number are broadcast to find their texts; more of them are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Counters of the sketch that says how often all documents have a shingle, and the parts that it is summed in.
COUNTERS, PARTS = 1 << 21, 64
#: A shingle that at least 1/SHARE of all documents (and this many) may have is dealt to SALTS tasks first.
SHARE, LEAST_HOT, SALTS = 1000, 10_000, 1024
#: Estimated similarity from which on a pair is taken as linked until it is verified.
SURE = 0.8
_LOW, _HIGH = np.array([(i, j) for j in range(FAN) for i in range(j)]).T


def bitmap(s: np.ndarray) -> bytes:
    width = BITS
    while width < min(2 * len(s), MOST_BITS):
        width *= 2
    bits = np.zeros(width, dtype=bool)
    bits[s & np.uint64(width - 1)] = True
    return np.packbits(bits).tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (in rows of 64-bit words) brought to a smaller width: bits whose numbers are equal modulo the width are one."""
    return maps if maps.shape[1] == words else np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


class SignatureTree:
    """Documents in order of size; a node of each level holds the OR and AND of its children's bitmaps, their least and largest size, and their component if it is one."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> None:
        self.order = np.argsort(sizes, kind="stable")
        level = (maps[self.order], maps[self.order], sizes[self.order], sizes[self.order])
        self.levels = [level]
        while len(level[2]) > FAN:
            at = np.arange(0, len(level[2]), FAN)
            level = (np.bitwise_or.reduceat(level[0], at), np.bitwise_and.reduceat(level[1], at), np.minimum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)
        self.name(comps)

    def name(self, comps: np.ndarray) -> None:
        """Sets the components of all nodes: -1 for a node of several."""
        self.comps = [comps[self.order]]
        for level in self.levels[:-1]:
            c, at = self.comps[-1], np.arange(0, len(level[2]), FAN)
            low, high = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
            self.comps.append(np.where(low == high, low, -1))


def _may_link(u: tuple, v: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether documents below nodes u[i] and v[j] can reach the similarity: each bit in all of one side and in none of the other is a shingle they don't share, and 7 * overlap >= 3 * (sum of sizes) is needed."""
    fits = (4 * u[3][i] >= 3 * v[2][j]) & (4 * v[3][j] >= 3 * u[2][i])
    k = np.flatnonzero(fits)
    a, b = i[k], j[k]
    x = np.bitwise_count(u[1][a] & ~v[0][b]).sum(axis=1, dtype=np.int64)
    y = np.bitwise_count(v[1][b] & ~u[0][a]).sum(axis=1, dtype=np.int64)
    fits[k] = (4 * u[3][a] >= 3 * v[2][b] + 7 * x) & (4 * v[3][b] >= 3 * u[2][a] + 7 * y)
    return fits


def dual_traversal(s: SignatureTree, t: SignatureTree, found: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Hands pairs of row numbers, one of each tree (or each pair once if it is one tree twice), that no bound rules out to `found`.

    Depth first, in pieces of bounded size; it may name the trees' components anew, which prunes what is still to come.
    """
    top = max(len(s.levels), len(t.levels)) - 1
    at = lambda tree, k: min(k, len(tree.levels) - 1)
    n, m = len(s.levels[at(s, top)][2]), len(t.levels[at(t, top)][2])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(m), indexing="ij"))
    work = [(top, i, j)]

    def below(tree: SignatureTree, k: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if k > len(tree.levels) - 1:
            return x[:, None], np.ones((len(x), 1), bool)
        c = x[:, None] * FAN + np.arange(FAN)
        return c, c < len(tree.levels[k - 1][2])

    while work:
        k, i, j = work.pop()
        if len(i) > PIECE:
            work += [(k, i[PIECE:], j[PIECE:]), (k, i[:PIECE], j[:PIECE])]
            continue
        if s is t:
            i, j = i[i <= j], j[i <= j]
        c, d = s.comps[at(s, k)][i], t.comps[at(t, k)][j]
        open_ = (c != d) | (c < 0)
        i, j = i[open_], j[open_]
        keep = _may_link(s.levels[at(s, k)], t.levels[at(t, k)], i, j)
        if s is t:
            keep |= i == j  # a node with itself
        i, j = i[keep], j[keep]
        if not k:
            if s is t:
                i, j = i[i != j], j[i != j]
            if len(i):
                found(s.order[i], t.order[j])
            continue
        (a, fa), (b, fb) = below(s, k, i), below(t, k, j)
        both = fa[:, :, None] & fb[:, None, :]
        if len(i):
            work.append((k - 1, np.broadcast_to(a[:, :, None], both.shape)[both], np.broadcast_to(b[:, None, :], both.shape)[both]))


class Rows:
    """Rows of blocks that a task holds: hashes of documents, sizes and bitmaps, these in one matrix a width."""

    def __init__(self, h: np.ndarray, n: np.ndarray, maps: list[bytes]) -> None:
        self.h, self.n = h, n
        self.words = np.array([len(x) // 8 for x in maps], np.int64)
        self.matrix, self.place = {}, np.zeros(len(maps), np.int64)
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.place[at] = np.arange(len(at))
            self.matrix[w] = np.frombuffer(b"".join([maps[k] for k in at.tolist()]), np.uint64).reshape(len(at), w)

    def maps(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of rows that have one width, folded."""
        return folded(self.matrix[int(self.words[rows[0]])][self.place[rows]], width)

    def compare(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows: whether bitmaps and sizes allow a link, and the similarity that they let expect."""
        n, m = self.n[i], self.n[j]
        fits, guess = (4 * n >= 3 * m) & (4 * m >= 3 * n), np.zeros(len(i))
        for w, v in {(int(a), int(b)) for a, b in zip(self.words[i[fits]], self.words[j[fits]], strict=True)}:
            k = np.flatnonzero(fits & (self.words[i] == w) & (self.words[j] == v))
            width = min(w, v)
            a, b = self.maps(i[k], width), self.maps(j[k], width)
            x, y = (np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((a, b), (b, a)))
            fits[k] = (4 * n[k] >= 3 * m[k] + 7 * x) & (4 * m[k] >= 3 * n[k] + 7 * y)
            free = [np.maximum(1 - np.bitwise_count(q).sum(axis=1, dtype=np.int64) / (64 * width), 0.05) for q in (b, a)]
            both = np.maximum(np.minimum(n[k] - x / free[0], m[k] - y / free[1]), 0)
            guess[k] = both / np.maximum(n[k] + m[k] - both, 1)
        return fits, guess


def _within(rows: Rows, label: np.ndarray, left: np.ndarray, right: np.ndarray, hopeful: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate pairs (i, j, sure) between two tiles of a block, or of one tile if both are the same, by a signature tree for each width of bitmaps; widths more than a step apart mean sizes that can't link."""
    out, trees = [], {}

    def tree(at: np.ndarray, width: int) -> SignatureTree:
        key = (int(at[0]), int(rows.words[at[0]]), width)
        if key not in trees:
            trees[key] = at, SignatureTree(rows.maps(at, width), rows.n[at], label[at])
        return trees[key][1]

    for w in np.unique(rows.words[np.concatenate((left, right))]).tolist():
        sides = [(left[rows.words[left] == w], right[rows.words[right] == w])]
        sides += [(left[rows.words[left] == w], right[rows.words[right] == 2 * w])]
        if left is not right:
            sides += [(left[rows.words[left] == 2 * w], right[rows.words[right] == w])]
        for x, y in sides:
            if not len(x) or not len(y):
                continue

            def found(a: np.ndarray, b: np.ndarray, x=x, y=y) -> None:
                i, j = x[a], y[b]
                fits, guess = rows.compare(i, j)
                sure = fits & (guess >= SURE) & hopeful
                merged = []
                for k in np.flatnonzero(sure).tolist():
                    p, q = label[i[k]], label[j[k]]
                    if p != q:
                        label[label == max(p, q)] = min(p, q)
                        merged.append(k)
                rest = np.flatnonzero(fits & ~sure & (label[i] != label[j]))
                k = np.concatenate((np.array(merged, np.int64), rest))
                if len(k):
                    out.append((i[k], j[k], np.arange(len(k)) < len(merged)))
                if merged:
                    for at, t in trees.values():
                        t.name(label[at])

            s = tree(x, w)
            dual_traversal(s, s if left is right and len(x) == len(y) and x[0] == y[0] and rows.words[y[0]] == w else tree(y, w), found)
    return out


def _blocks(members: DataFrame, hopeful: bool) -> DataFrame:
    """Candidate pairs (block, a, b, sure) within blocks, from rows (block, left, right, tile, h, n, map, comp).

    Blocks of at most FAN rows are single nodes, and many of these are compared at once; each larger block goes through signature
    trees. If `hopeful`, a pair that is surely linked by the bitmaps' estimate joins components at once, which rules out most pairs of
    a group of near copies; `sure` marks these pairs, and a block for which one of them proves wrong must be searched again without.
    """

    def pairs(cols: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        block, left, right, tile, h, n, maps, comp = cols
        rows, ends = Rows(h, n, maps.tolist()), np.append(starts[1:], len(h))
        size, label = ends - starts, np.unique(comp, return_inverse=True)[1]
        found = []
        small = (size <= FAN) & (left[starts] == right[starts])
        count = size[small] * (size[small] - 1) // 2
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        base = np.repeat(starts[small], count)
        i, j = base + _LOW[k], base + _HIGH[k]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        fits, guess = rows.compare(i, j)
        found.append((i[fits], j[fits], np.zeros(int(fits.sum()), bool)))
        for a, b in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
            at = np.arange(a, b)
            x = at[tile[a:b] == left[a]]
            y = x if left[a] == right[a] else at[tile[a:b] == right[a]]
            own = label.copy() if hopeful else label
            if len(x) and len(y):
                found += _within(rows, own, x, y, hopeful)
        i, j, sure = (np.concatenate([f[k] for f in found]) for k in range(3))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(block[i]), pa.array(np.minimum(h[i], h[j])), pa.array(np.maximum(h[i], h[j])), pa.array(sure)], names=["block", "a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            count += b.num_rows
            size += b.nbytes
            if count > 4 * TILE or size > HELD_BYTES:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                starts = _starts(cols)
                last = int(starts[-1])  # the last group may go on
                if last:
                    yield from pairs([c[:last] for c in cols], starts[:-1])
                held = [[c[last:] for c in cols]]
                count, size = len(cols[0]) - last, 0
        if held and len(held[-1][0]):
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield from pairs(cols, _starts(cols))

    rows = members.select("block", "left", "right", "tile", "h", "n", "map", "comp")
    return rows.repartition("block", "left", "right").sortWithinPartitions("block", "left", "right").mapInArrow(run, "block long, a long, b long, sure boolean")


def _starts(cols: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(cols[0]), bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
    return np.flatnonzero(new)


_SET = "id long, rid long, n long, sig binary, h long, map binary, part long"


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """Of rows (id, rid, text): size of the shingle set, a 128-bit hash of it, the hash's first half, and the bitmap; and for each task rows with a part of its sketch."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(COUNTERS, np.int64)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
        names = [x.split()[0] for x in _SET.split(", ")]
        for b in batches:
            out = []
            for s in each_set(b.column(2), k):
                np.add.at(sketch, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                sig = hashlib.md5(s.tobytes()).digest()
                out.append((len(s), sig, int.from_bytes(sig[:8], "little", signed=True), bitmap(s), None))
            if out:
                cols = [b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types[2:], strict=True))]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        for p, part in enumerate(np.split(sketch, PARTS)):
            if part.any():
                row = [None, None, None, None, None, zlib.compress(part.tobytes(), 1), p]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    return rows.mapInArrow(made, _SET)


def _summed(parts: DataFrame) -> np.ndarray:
    """The sketch: counters that no shingle's number of documents exceeds. Summed part by part in tasks; what comes to the driver has a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[p] = total.get(p, 0) + np.frombuffer(zlib.decompress(data), np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "map"])

    sketch = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for r in parts.repartition("part").mapInArrow(add, "part long, map binary").collect():  # PARTS rows
        sketch[r.part] = np.frombuffer(zlib.decompress(r.map), np.int64)
    return sketch.ravel()


def _prefixes(rows: DataFrame, k: int, spark: SparkSession, sketch: np.ndarray, hot: int) -> DataFrame:
    """(s, h, hot): the first n - ceil(3n / 4) + 1 shingles of each set, in the order of how often all documents have them by the sketch. Sets that reach the similarity share one of these."""
    shared = spark.sparkContext.broadcast(np.minimum(sketch, (1 << 24) - 1).astype(np.uint32))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            parts, own = [], []
            for s in each_set(b.column(0), k):
                if len(s):
                    often = counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    order = np.argsort(often.astype(np.uint64) << np.uint64(40) | s >> np.uint64(24), kind="stable")[: len(s) - (3 * len(s) + 3) // 4 + 1]
                    parts.append(np.stack((s[order].view(np.int64), np.full(len(order), np.frombuffer(hashlib.md5(s.tobytes()).digest()[:8], np.int64)[0]), often[order] >= hot)))
            if parts:
                s, h, often = np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(h), pa.array(often.astype(bool))], names=["s", "h", "hot"])

    return rows.select("text").mapInArrow(made, "s long, h long, hot boolean")


def _members(prefixes: DataFrame) -> DataFrame:
    """(block, h): a document and the block that it belongs to, which the least hash among those with a prefix shingle names.

    The rows are shuffled once. Shingles that the sketch shows to be of few documents are small groups; those that may be of very many are
    dealt to SALTS groups, whose least hashes, a few rows, then give that of the shingle by a join that deals hot ones.
    """
    by = Window.partitionBy("s", "salt")
    d = prefixes.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("h"), F.lit(SALTS))).otherwise(F.lit(-1)))
    d = d.withColumns({"block": F.min("h").over(by), "last": F.max("h").over(by)}).filter("hot or block <> last")
    d = stored(d.select(F.when(F.col("hot"), F.col("s")).alias("s"), "block", "h").distinct(), "prefix-blocks")
    hot = d.filter("s is not null").select("s", "h", F.col("block").alias("part"))
    least = stored(hot.groupBy("s").agg(F.min("part").alias("block"), F.count("*").alias("w")).filter("w > 1"), "hot-blocks")
    often = lookup(hot.drop("part"), least, "s", "w", F.xxhash64("h", F.lit("spread"))).filter("block is not null").select("block", "h")
    return d.filter("s is null").select("block", "h").union(often).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Of pairs (a, b) of hashes, those whose sets are alike, as (a, b, x, y) with the sets' 128-bit hashes. Only the texts of documents that occur are looked at, once; their sets are stored for the joins."""
    ids = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    ids = stored(ids.join(classes.select("h", "sig", "rid"), "h"), "to-compare")
    wanted = ids if ids.count() > BROADCAST_IDS else F.broadcast(ids)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, sig, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), each_set(b.column(2), k), strict=True):
                if hashlib.md5(s.tobytes()).digest() == sig:
                    yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([sig], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s.view(np.int64)))], names=["h", "sig", "shingles"])

    sets = stored(rows.join(wanted, "rid").select("h", "sig", "text").mapInArrow(full, "h long, sig binary, shingles array<long>").dropDuplicates(["sig"]), "sets")
    of = lambda c, x: sets.select(F.col("h").alias(c), F.col("sig").alias(x), F.col("shingles").alias(f"_{c}"))
    both = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - both
    return pairs.select("a", "b").distinct().join(of("a", "x"), "a").join(of("b", "y"), "b").filter((100 * both >= 75 * union) & (F.col("x") != F.col("y"))).select("a", "b", "x", "y")


def _named(members: DataFrame, comps: DataFrame, classes: DataFrame) -> DataFrame:
    """members with n, map, sig and comp, a number for the component so far."""
    m = members.join(classes.select("h", "sig", "n", "map"), "h")
    return m.join(comps.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("comp", F.xxhash64(F.coalesce("component", "sig"))).drop("component")


def ngram_components(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: documents link when their sets of k-word shingles have a Jaccard similarity of 0.75 or more.

    1. Documents with equal sets are one class; from here on only classes count.
    2. Sets that are alike share a shingle of their prefixes, in the order of a sketch that counts the shingles of all documents, rare ones
       first. The documents with a prefix shingle are a block; blocks with the same least document are one.
    3. Each block's bitmaps make a signature tree, whose dual traversal drops pairs of nodes with too little possible overlap or of one
       component. What is left is verified exactly. Blocks of many rows are dealt twice to tiles of bounded size, by two hashes.
    4. Blocks where a pair that seemed sure proves wrong, and blocks of several tiles that are not of one component then, go through the trees
       again, tile by tile with each other, with verified components alone. So no link between components is lost.

    Texts without words (null, empty) have no shingles and link with nothing. Rows that share an id are one document, in one
    component, whatever their texts. A row with a null id can't be named: it links its class, and its component_id is the smallest id there, null if
    there is none. Repeated rows give repeated results; ties can't occur; very long texts count whole; an empty table gives an empty result.
    Other columns of docs are not looked at, so their names don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    made = stored(_sets(rows, k), "shingle-sets")
    light = made.filter("part is null")
    sketch = _summed(made.filter("part is not null").select("part", "map"))
    classes = light.filter("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.min("rid").alias("rid"), F.count("*").alias("copies"), *(F.max(c).alias(c) for c in ("n", "h", "map")))
    classes = stored(classes, "shingle-classes")
    members = stored(_members(_prefixes(rows, k, spark, sketch, max(light.count() // SHARE, LEAST_HOT))), "block-members")
    sizes = members.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("w")).filter("w > 1")
    sizes = stored(sizes, "block-sizes")
    tiled = lookup(members, sizes, "block", "w", F.xxhash64("h", F.lit("spread"))).filter("tiles is not null")
    dealt = lambda seed: F.pmod(F.xxhash64("h", F.lit(seed)), F.col("tiles")).cast("long")
    seeds = F.when(F.col("tiles") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    first = tiled.withColumn("seed", F.explode(seeds)).withColumn("tile", F.when(F.col("seed") == 0, dealt(0)).otherwise(dealt(1)) * 2 + F.col("seed"))
    first = first.select("block", F.col("tile").alias("left"), F.col("tile").alias("right"), "tile", "h", F.col("h").alias("comp")).join(classes.select("h", "n", "map"), "h")
    near = stored(_blocks(first, True), "near-in-trees")
    links = stored(_verified(near, rows, classes, k), "links-in-trees")
    comps = stored(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "components-in-trees")

    wrong = near.filter("sure").join(links, ["a", "b"], "left_anti").select("block").distinct().withColumn("wrong", F.lit(True))
    again = sizes.join(wrong, "block", "left").filter("tiles > 1 or wrong").select("block", "tiles", "w")
    named = _named(members.select("block", "h").join(again.select("block"), "block", "left_semi"), comps, classes)
    open_ = named.groupBy("block").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).filter("p <> q").select("block")
    open_ = stored(open_.join(again, "block"), "open-blocks")
    every = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    if not open_.isEmpty():
        m = named.join(open_.select("block", "tiles"), "block").withColumn("tile", dealt(0)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - F.lit(1).cast("long"))))
        m = m.select("block", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "tile", "h", "n", "map", "comp")
        second = stored(_verified(stored(_blocks(m, False), "near-in-tiles"), rows, classes, k), "links-in-tiles")
        every = every.union(second.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # Texts that share an id are one document.
    several = light.filter("n > 0 and id is not null").groupBy("id").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).filter("low <> high").select("id", "low")
    same = stored(light.filter("n > 0").select("id", "sig").join(several, "id").filter("sig <> low").select(F.col("low").alias("a"), F.col("sig").alias("b")).distinct(), "texts-of-one-id")
    if not open_.isEmpty() or not same.isEmpty():
        comps = stored(components(every.union(same)), "components")
    tops = comps.join(classes.select(F.col("sig").alias("node"), "rep"), "node")
    tops = tops.join(tops.groupBy("component").agg(F.min("rep").alias("top")), "component").select(F.col("node").alias("sig"), "top")
    named = stored(classes.select("sig", "rep", "copies").join(tops, "sig", "left").select("sig", "copies", F.coalesce("top", "rep").alias("comp")), "class-components")
    out = lookup(light.select("id", "n", "sig"), named, "sig", "copies", F.unhex(F.md5(F.concat(F.lit("row"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))
