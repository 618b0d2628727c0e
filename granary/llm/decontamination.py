"""Benchmark decontamination: documents that hold a benchmark passage, whole or with few words changed.

Words are the alphabet. The CGK random walk maps a window of words to a longer string so that few edits become few
differing places; sampled places are keys of LSH tables; what meets an item there is verified by exact edit distance.
Sizes for which keys would meet too seldom do without: there, whatever keeps enough grams of an item is verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import small_batches
from granary.llm.shingles import PLAIN, each_words, mix, word_hashes

#: Places of the embedding that make a key, and most repetitions; sizes that need more have no walks, and all that gram hits leave is verified.
SAMPLED, MOST_REPEATS = 3, 64
#: Simulated copies that judge the repetitions of a size. They can't show a recall near 1, so that then all is verified.
COPIES = 1000
#: Larger windows need far more repetitions.
LONGEST = 256
#: Gram hits of texts that are looked at in one go.
HITS = 1_000_000
#: Characters of benchmark text that one pass over the documents takes; a larger benchmark takes several passes.
BLOCK_CHARS = 16_000_000
_C = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> np.ndarray:
    """Hashes of words in lower case, signs of ASCII aside."""
    return word_hashes(text, PLAIN)


def allowed(n: int, share: float) -> int:
    return int(share * n + 1e-9)


def gram_size(n: int, share: float) -> int:
    """At most 3, and so short that of n words with the allowed number edited, some run of this length is whole."""
    return next((g for g in (3, 2) if n // g > allowed(n, share)), 1)


def window_size(n: int) -> int:
    """The largest of 1, 2, 3, 4, 6, 8, 12, 16, 24, ... that n words fill."""
    size = 1
    for k in range(1, 40):
        for s in (2**k, 3 * 2 ** (k - 1)):
            if s <= n:
                size = max(size, s)
    return size


class Walk:
    """One repetition for windows of a size: CGK's walk of 2 * size steps, of which SAMPLED places give the key."""

    def __init__(self, size: int, seed: int) -> None:
        r = np.random.default_rng([size, seed])
        self.turns = r.integers(1, 2**63, 2 * size, dtype=np.uint64)
        self.places = set(r.choice(2 * size, min(SAMPLED, 2 * size), replace=False).tolist())

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """A key for each row of words; the last column stands for the end."""
        at, row, key = np.zeros(len(windows), np.int64), np.arange(len(windows)), np.zeros(len(windows), np.uint64)
        for j in range(max(self.places) + 1):
            symbol = windows[row, at]
            if j in self.places:
                key = mix(key * np.uint64(31) + symbol)
            at = np.minimum(at + (((symbol ^ self.turns[j]) * _C) >> np.uint64(63)).astype(np.int64), windows.shape[1] - 1)
        return key


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance between the item and any run of words of text, and where the first such run ends."""
    step = np.arange(len(item) + 1)
    d, best, end = step.copy(), len(item), 0
    for k, w in enumerate(text):
        new = np.concatenate(([0], np.minimum(d[:-1] + (item != w), d[1:] + 1)))
        d = np.minimum.accumulate(new - step) + step
        if d[-1] < best:
            best, end = int(d[-1]), k + 1
    return best, end


def begins(item: np.ndarray, text: np.ndarray, end: int) -> int:
    """Where the best match that ends at `end` begins: of runs with the least edit distance to the item, one that begins with the item's first word, and then the longest."""
    back, d = text[:end][::-1], np.arange(len(item) + 1)
    step, of = d.copy(), item[::-1]
    best = (int(d[-1]), True, 0)
    for k, w in enumerate(back[: 2 * len(item) + 1].tolist(), 1):
        new = np.concatenate(([k], np.minimum(d[:-1] + (of != w), d[1:] + 1)))
        d = np.minimum.accumulate(new - step) + step
        best = min(best, (int(d[-1]), bool(w != item[0]), -k))
    return end + best[2]


@dataclass
class Index:
    """Items by window size: their words, the walks (none: all is verified), and sorted keys with item numbers for each walk; and the sorted grams with the items and places that have them."""

    ids: list[int]
    items: list[np.ndarray]
    share: float
    by_size: dict[int, tuple[list[Walk], list[tuple[np.ndarray, np.ndarray]]]]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _padded(rows: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((len(rows), size + 1), np.uint64)
    for i, r in enumerate(rows):
        out[i, : min(size, len(r))] = r[:size]
    return out


def _copies(items: list[np.ndarray], size: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items for COPIES simulated copies with the most edits, as windows; and the windows that search lays for them amid other words, with their copies."""
    r = np.random.default_rng(size)
    order = r.permutation(len(items))
    own, windows, of = [], [], []
    for c in range(COPIES):
        item = items[order[c % len(items)]]
        e, g = allowed(len(item), share), gram_size(len(item), share)
        x = item.tolist()
        for _ in range(e):
            kind, at = r.integers(3), int(r.integers(len(x)))
            new = int(r.integers(1, 2**63))
            x = x[:at] + ([new] if kind == 0 else [new, x[at]] if kind == 1 else []) + x[at + 1 :] or x
        text = np.concatenate((r.integers(1, 2**63, e, dtype=np.uint64), np.array(x, np.uint64), r.integers(1, 2**63, size, dtype=np.uint64)))
        at, place = np.nonzero(_grams(text, g)[:, None] == _grams(item, g)[None, :])
        begins = np.unique(np.maximum(at - place, 0))
        own.append(item)
        windows += [text[k : k + size] for k in begins.tolist()]
        of.append(np.full(len(begins), c))
    return _padded(own, size), _padded(windows, size), np.concatenate(of)


def _repeats(items: list[np.ndarray], size: int, share: float, recall: float) -> int:
    """As many walks as find `recall` of simulated copies that have the most edits allowed, with two standard errors to spare; 0 if MOST_REPEATS are too few."""
    if size > LONGEST:
        return 0
    own, windows, of = _copies(items, size, share)
    met = np.zeros(COPIES, bool)
    for n in range(1, MOST_REPEATS + 1):
        w = Walk(size, n - 1)
        met[of[w.keys(windows) == w.keys(own)[of]]] = True
        share_met = (met.sum() + 2) / (COPIES + 4)  # Agresti and Coull, so that no estimate is without error
        if n >= 8 and share_met - 2 * np.sqrt(share_met * (1 - share_met) / COPIES) >= recall:
            return n
        if n >= 8 and (1 - met.mean()) ** (MOST_REPEATS / n) > 1 - recall:  # later walks find no larger share of what is left
            return 0
        left = ~met[of]
        windows, of = windows[left], of[left]
    return 0


def build_index(rows: list[tuple[int, str]], share: float, recall: float) -> Index:
    ids, items = [], []
    for item, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        if len(w):
            ids.append(item)
            items.append(w)
    by_size, sizes = {}, [window_size(len(w)) for w in items]
    for size in sorted(set(sizes)):
        own = np.array([i for i, s in enumerate(sizes) if s == size])
        rows_ = [items[i] for i in own]
        walks = [Walk(size, n) for n in range(_repeats(rows_, size, share, recall))]
        tables = []
        for w in walks:
            k = w.keys(_padded(rows_, size))
            order = np.argsort(k, kind="stable")
            tables.append((k[order], own[order]))
        by_size[size] = walks, tables
    grams: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i, w in enumerate(items):
        g = gram_size(len(w), share)
        h = _grams(w, g)
        grams.setdefault(g, []).append((h, np.full(len(h), i), np.arange(len(h))))
    out = {}
    for g, parts in grams.items():
        h, i, at = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.argsort(h, kind="stable")
        out[g] = h[order], i[order], at[order]
    return Index(ids, items, share, by_size, out)


def _grams(w: np.ndarray, g: int) -> np.ndarray:
    h = np.zeros(max(0, len(w) - g + 1), np.uint64)
    for k in range(g):
        h = mix(h * _C + w[k : len(w) - g + 1 + k]) if len(h) else h
    return h


def _seen(h: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Where keys occur in h; flags has a bit for the upper 20 bits of each key."""
    at = np.flatnonzero(flags[(h >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    return at[keys[k] == h[at]]


def _likely(row: np.ndarray, item: np.ndarray, diagonal: np.ndarray, need: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of gram hits those that a copy may have, by row, item and diagonal: it keeps `need` grams of the item, on diagonals at most `edits` apart."""
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal = row[order], item[order], diagonal[order]
    group = np.cumsum(np.concatenate(([0], (np.diff(row) != 0) | (np.diff(item) != 0))))
    key = group * (int(diagonal.max()) - int(diagonal.min()) + int(edits.max()) + 2) + diagonal - diagonal.min()
    end = np.searchsorted(key, key + edits[item], "right")
    full = np.flatnonzero(end - np.arange(len(key)) >= need[item])
    edge = np.zeros(len(key) + 1, np.int64)
    np.add.at(edge, full, 1)
    np.add.at(edge, end[full], -1)
    keep = np.cumsum(edge)[:-1] > 0
    return row[keep], item[keep], diagonal[keep]


def search(texts: pa.Array, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, end, edit distance) for each text and each item that it holds: the best match around the first window, in order of words, that leads to one.

    A text with more than HITS gram hits is searched in slices of its words, which overlap by what the longest item's copy can span; items that were found are not looked for in later slices.
    """
    flags = {}
    for g, (keys, _, _) in index.grams.items():
        flags[g] = np.zeros(1 << 20, bool)
        flags[g][(keys >> np.uint64(44)).astype(np.int64)] = True
    large: list[tuple[int, np.ndarray, np.ndarray]] = []
    out = _search(enumerate(each_words(texts, PLAIN)), index, flags, np.zeros(len(index.items), bool), large)
    reach = max((len(w) + 2 * allowed(len(w), index.share) for w in index.items), default=0) + 1
    for row, w, n_hits in large:
        before, at, done = np.cumsum(n_hits), 0, np.zeros(len(index.items), bool)
        while at < len(w):
            seen = int(before[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(before, seen + HITS // 2, "right")))
            for _, i, first, end, distance in _search([(row, w[at : stop + reach])], index, flags, done, None):
                if at + first < stop:  # else the next slice has it whole
                    out.append((row, i, at + first, at + end, distance))
                    done[i] = True
            at = stop
    return [(row, index.ids[i], *x) for row, i, *x in sorted(out)]


def _search(rows: Iterable[tuple[int, np.ndarray]], index: Index, flags: dict[int, np.ndarray], done: np.ndarray, large: list | None) -> list[tuple[int, int, int, int, int]]:
    """See search, with places of items in the index instead of their ids. `rows` are numbers and words, `done` the items that are left out; rows with too many hits go to `large` with the hits of each word, if that is a list."""
    docs: dict[int, np.ndarray] = {}
    starts: list[np.ndarray] = []  # row, window start, window size
    whole: list[np.ndarray] = []  # row, item, diagonal, of items without walks
    size_of = np.array([window_size(len(w)) for w in index.items], np.int64)
    edits = np.array([allowed(len(w), index.share) for w in index.items], np.int64)
    g_of = np.array([gram_size(len(w), index.share) for w in index.items], np.int64)
    need = np.maximum(1, np.array([len(w) for w in index.items], np.int64) - g_of + 1 - g_of * edits)
    walked = np.array([bool(index.by_size[s][0]) for s in size_of.tolist()], bool)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_hits = 0

    def look() -> None:
        row, item, diagonal = _likely(*(np.concatenate([h[k] for h in hits]) for k in range(3)), need, edits)
        w = walked[item]
        starts.append(np.unique(np.stack((row[w], np.maximum(diagonal[w], 0), size_of[item[w]]), axis=1), axis=0))
        whole.append(np.stack((row[~w], item[~w], diagonal[~w]), axis=1))
        kept = {*starts[-1][:, 0].tolist(), *whole[-1][:, 0].tolist()}
        for r in {int(h[0][0]) for h in hits} - kept:
            docs.pop(r, None)
        hits.clear()

    for row, w in rows:
        if n_hits > HITS:  # between texts, so that all hits of one are seen together
            look()
            n_hits = 0
        own, at_word = [], np.zeros(len(w), np.int64)
        for g, (keys, item, place) in index.grams.items():
            h = _grams(w, g)
            at = _seen(h, keys, flags[g])
            if not len(at):
                continue
            low = np.searchsorted(keys, h[at], "left")
            n = np.searchsorted(keys, h[at], "right") - low
            at_word[at] += n
            own.append((at, low, n, item, place))
        if large is not None and at_word.sum() > HITS:
            large.append((row, w.copy(), at_word))
            continue
        for at, low, n, item, place in own:
            k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            left = ~done[item[k]]
            if left.any():
                docs[row] = w
                hits.append((np.full(int(left.sum()), row), item[k][left], (np.repeat(at, n) - place[k])[left]))
                n_hits += int(left.sum())
    if hits:
        look()
    if not starts:
        return []
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    every = np.unique(np.concatenate(starts), axis=0)
    for size, (walks, tables) in index.by_size.items():
        mine = every[every[:, 2] == size]
        for at in range(0, len(mine), 20_000):
            part = mine[at : at + 20_000]
            windows = _padded([docs[r][b : b + size] for r, b, _ in part.tolist()], size)
            met = []
            for walk, (keys, item) in zip(walks, tables, strict=True):
                key = walk.keys(windows)
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = high - low
                if n.any():
                    k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    met.append(np.stack((np.repeat(np.arange(len(part)), n), item[k]), axis=1))
            for p, i in np.unique(np.concatenate(met), axis=0).tolist() if met else ():
                row, begin, _ = part[p].tolist()
                if (row, i) in found:
                    continue
                w, e = index.items[i], allowed(len(index.items[i]), index.share)
                first = max(0, begin - e)
                distance, end = best_match(w, docs[row][first : begin + len(w) + 2 * e])
                if distance <= e:
                    found[row, i] = (first + begins(w, docs[row][first:], end), first + end, distance)
    rest = np.concatenate(whole)
    cut = np.flatnonzero(np.any(np.diff(rest[:, :2], axis=0) != 0, axis=1) | (np.diff(rest[:, 2]) > LONGEST)) + 1
    for near in np.split(rest, cut) if len(rest) else ():
        row, i, low = near[0].tolist()
        w, e = index.items[i], int(edits[i])
        first = max(0, low - e)
        distance, end = best_match(w, docs[row][first : int(near[-1, 2]) + len(w) + 2 * e])
        if distance <= e and (row, i) not in found:
            found[row, i] = (first + begins(w, docs[row][first:], end), first + end, distance)
    return [(row, i, *x) for (row, i), x in found.items()]


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, end_word, distance) for each row of docs and each item that it holds.

    A document holds an item if a run of its words has an edit distance, in words, of at most `share` times the item's words.
    Windows of the item's size are laid wherever a document has a gram of an item (at most three words; by the pigeonhole
    principle every copy with so few edits keeps one) and as many more on near diagonals as every such copy keeps, so each window is
    looked up, never all documents against all items. Copies with the most edits are found with probability `recall`, exact copies
    always; where MOST_REPEATS walks would find fewer, all that keeps so many grams is verified, so every copy is found. Verified by exact edit distance.

    The benchmark goes through in blocks of BLOCK_CHARS, each a pass over the documents, so what a task holds is bounded.
    Of several places of an item in a document, the first that a window leads to is given: first_word and end_word are where its best match
    begins and ends, the first of equally good ends. Very long texts are searched whole; empty tables give an empty result.
    Null and empty texts and items match nothing. Repeated rows and ids count as they are; null ids are kept. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).filter(F.col("id").isNotNull() & (F.char_length("text") > 0))
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) if total > BLOCK_CHARS else 1
    out = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).distinct().collect()
        shared = spark.sparkContext.broadcast(build_index([tuple(r) for r in rows], share, recall))

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, hits = batch.column(0), search(batch.column(1), shared.value)
                if hits:
                    cols = list(zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "item_id", "first_word", "end_word", "distance"])

        part = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(found, "doc_id long, item_id long, first_word long, end_word long, distance long")
        out = part if out is None else out.union(part)
    return out
