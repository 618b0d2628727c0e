"""Periodic runs: stretches of words that repeat themselves, found by seeds on diagonals and extended."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fresh, others, pieces_of, small_batches
from granary.llm.shingles import mix

#: Bytes of texts whose grams are indexed together, and of a text that is split into words at once.
BATCH, PIECE = 1 << 23, 1 << 20
MADE = ("n_words", "runs", "collapsed_text")
_END = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def codes_of(text: bytes, table: defaultdict) -> np.ndarray:
    """A number for each word; equal words have equal numbers. The text is split piece by piece, at white space."""
    at, out = 0, []
    while at < len(text):
        m = _END.search(text, at + PIECE)
        end = m.start() if m else len(text)
        words = text[at:end].split()  # at the white space of the contracts, as these are bytes
        out.append(np.fromiter(map(table.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def seeds(codes: np.ndarray, edges: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of neighbouring equal grams within a text, of all texts; text t is codes[edges[t]:edges[t + 1]].

    A run of period q has at least max(least, repeats * q) words and so as many less q on its diagonal. Grams as long as the least such overlap serve
    the periods up to their length, grams twice as long those up to twice it, and so on: within a run, equal grams at least as long as the period are
    never nearer than the period, so the next equal gram is the pair to look at, and the pairs are no more than the words. Only grams that
    occur twice are made longer.
    """
    k, low = min(max(least, repeats * q) - q for q in range(1, least + 1)), 0
    sizes = np.diff(edges)
    end = np.repeat(edges[1:], sizes)
    at = np.flatnonzero(np.arange(len(codes)) + k <= end)
    gram = mix(np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64))  # of other texts: never equal
    words = mix(codes.astype(np.uint64) * _ODD)
    for i in range(k):
        gram[: len(gram) - i] = mix(gram[: len(gram) - i] * _ODD + words[i:])
    found, lags = [], []
    longest = int(sizes.max(initial=0))
    while len(at) and repeats * (low + 1) <= longest:
        key = gram[at]
        order = np.argsort(key, kind="stable")  # equal grams stay in the order of their places
        at, same = at[order], np.flatnonzero(key[order[1:]] == key[order[:-1]])
        lag = at[same + 1] - at[same]
        use = (lag > low) & (lag <= k)
        found.append(at[same][use])
        lags.append(lag[use])
        twice = np.zeros(len(codes), bool)
        twice[at[same]] = twice[at[same + 1]] = True
        at = np.flatnonzero(twice)
        at = at[at + 2 * k <= end[at]]
        at = at[twice[at + k]]
        gram[at] = mix(gram[at] * _ODD + gram[at + k])
        low, k = k, 2 * k
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, lags = np.concatenate(found), np.concatenate(lags)
    order = np.argsort(found, kind="stable")
    return found[order], lags[order]


def _matches(codes: np.ndarray, at: int, lag: int, stop: int, step: int) -> int:
    """The first place from `at` on, going by step, that differs from the word `lag` after it, or stop. Looks at ever longer slices."""
    size = 64
    while at != stop:
        n = min(size, abs(stop - at))
        low = at if step > 0 else at - n + 1
        differ = np.flatnonzero(codes[low : low + n] != codes[low + lag : low + lag + n])
        if len(differ):
            return low + int(differ[0] if step > 0 else differ[-1])
        at, size = at + step * n, 2 * size
    return stop


def runs_of(codes: np.ndarray, edges: np.ndarray, least: int = 24, repeats: int = 3) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period), by start, then period. Of each lag, how far it is covered is kept, so that no stretch is extended twice."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(edges) - 1)]
    places, lags = seeds(codes, edges, least, repeats)
    texts = np.searchsorted(edges, places, "right") - 1
    covered: dict[int, int] = {}
    for i, lag, text in zip(places.tolist(), lags.tolist(), texts.tolist(), strict=True):
        if i < covered.get(lag, 0):
            continue
        low, high = int(edges[text]), int(edges[text + 1])
        right = _matches(codes, i, lag, high - lag, 1)
        covered[lag] = max(right, i + 1)
        if right == i:
            continue  # equal hashes, other words
        left = _matches(codes, i, lag, low - 1, -1) + 1
        length = right - left + lag
        if length >= max(least, repeats * lag):
            out[text].append((left - low, length, lag))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those of a run after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:n]) == 0


def find_runs(docs: DataFrame, least: int = 24, repeats: int = 3, text_col: str = "text") -> DataFrame:
    """docs with n_words, `runs` (start, length and period in words, by start, then period) and collapsed_text: each run cut to its first period, words joined by a space.

    A run is a stretch of words with smallest period q and at least max(least, repeats * q) words that no neighbour extends; `repeats` is 3 or more. One map over
    the table, without shuffle: texts are held in slices of BATCH bytes, or one at a time if they are longer.

    Null and empty texts have no words and no run. Very long texts are taken whole; a word repeated throughout is one run. Runs that tie in start are told
    apart by their period; repeated rows give equal results; an empty table gives an empty result. Columns with the three names are replaced, others stay.
    """
    if repeats < 3 or least < 1:
        raise ValueError("runs need at least three repeats and one word")
    small_batches(docs.sparkSession)

    @F.arrow_udf("n long, runs array<struct<start long, length long, period long>>, text string")
    def found(texts: pa.Array) -> pa.Array:
        sizes, runs, collapsed = [], [], []
        for part in pieces_of(texts, BATCH):
            table: defaultdict = defaultdict(count().__next__)
            coded = [codes_of(t or b"", table) for t in part.cast(pa.binary()).to_pylist()]
            edges = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
            spelled = list(table)
            own = runs_of(np.concatenate(coded), edges, least, repeats)
            sizes += [len(c) for c in coded]
            runs += [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in own]
            collapsed += [b" ".join(map(spelled.__getitem__, (c[kept_words(len(c), rs)] if rs else c).tolist())) for c, rs in zip(coded, own, strict=True)]
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).view(pa.string())], ["n", "runs", "text"])

    at = fresh("found", docs)
    d = docs.withColumn(at, found(F.col(text_col)))
    return d.select(*others(docs, MADE), *(F.col(at)[x].alias(n) for x, n in zip(("n", "runs", "text"), MADE, strict=True)))


def best_run(runs: Column) -> Column:
    """Of runs by start, then period, the first of those with the greatest length/period; null if there is none."""
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    return F.reduce(runs, F.get(runs, F.lit(0)), better)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose texts have a run planted where h = crc32(id) ends in 0: words from a = (h // 10) % n on repeat the first p = 1 + (n - a) // (3 + h // 10 % 8) of them. Other texts, and those without words, stay as they are."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def plant(texts: pa.Array, ids: pa.Array) -> pa.Array:
        out = []
        for text, id_ in zip(texts.cast(pa.binary()).to_pylist(), ids.to_pylist(), strict=True):
            words = text.split() if text else []
            if words:
                g, n = zlib.crc32((id_ or "").encode()) // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join(words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a])
            out.append(text)
        return pa.array(out, pa.binary()).view(pa.string())

    id_, at = F.col(id_col).cast("string"), fresh("planted", docs)
    chosen = F.crc32(F.coalesce(id_, F.lit("")).cast("binary")) % 10 == 0
    d = docs.withColumn(at, plant(F.when(chosen, F.col(text_col)), id_))
    return d.select(*(F.coalesce(F.col(at), F.col(c)).alias(c) if c.lower() == text_col.lower() else F.col(c) for c in docs.columns))
