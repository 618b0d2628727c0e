"""Language ID: normalised TF-IDF vectors of hashed character n-grams against several centroids per language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fresh, others, small_batches, stored

DIM = 1 << 13
#: Languages that can be learnt.
MOST_LANGUAGES = 1000
#: Where a floor lies between foreign texts (0) and known ones (1), and how many of the foreign texts it has to be above.
NEAR, FOREIGN = 0.2, 0.95
#: Lengths in characters of the pieces of texts that set floors.
PIECES = [6 * 2**k for k in range(12)]
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a space."""
    if not _FOLD:
        _FOLD.append(np.fromiter((ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, range(0x110000))), dtype=np.uint32, count=0x110000))
    return _FOLD[0]


def grams(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of one, two and three characters; None if the text is null or has no letter. Runs of other characters are one space."""
    if not text:
        return None
    a = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    a = np.concatenate(([np.uint32(32)], a, [np.uint32(32)]))
    space = a == 32
    if space.all():
        return None
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    a = a[keep]
    one = a * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(5) + a[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(3) + a[2:] * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    return np.concatenate([((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift for x in (one[a != 32], two, three)])


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of n-gram counts for each text, and how many n-grams it has (0: no letter)."""
    out, n = np.zeros((len(texts), DIM), dtype=np.float32), np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if (g := grams(t)) is not None:
            out[i], n[i] = np.bincount(g, minlength=DIM), len(g)
    return out, n


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)


def _clusters(v: np.ndarray, k: int, rounds: int = 8, odd: float = 0.1, least: float = 0.02) -> np.ndarray:
    """Spherical k-means, begun at the mean and the texts farthest from what is chosen already. The share `odd` of texts that are farthest from the mean, among them those with a wrong label, begin no cluster, and one with under `least` of the texts is left out."""
    unit = lambda x: x / max(float(np.sqrt((x * x).sum())), 1e-9)
    c = unit(v.mean(axis=0))[None, :]
    near = v @ c[0]
    plain = v[near >= np.quantile(near, odd)]
    while len(c) < min(k, len(v)):
        c = np.vstack([c, plain[int(np.argmin((plain @ c.T).max(axis=1)))]])
    for _ in range(rounds):
        at = (v @ c.T).argmax(axis=1)
        c = np.array([unit(v[at == i].mean(axis=0)) if (at == i).any() else c[i] for i in range(len(c))])
    size = np.bincount((v @ c.T).argmax(axis=1), minlength=len(c))
    return c[size >= max(1, least * len(v))].astype(np.float32)


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(n, 1)).astype(int)


def _nearest(cos: np.ndarray, starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of cosines to centroids, those of a language beginning at each of `starts`: the nearest language, its cosine, and its lead over the next (with one language the cosine itself)."""
    each = np.maximum.reduceat(cos, starts, axis=1)
    best, top = each.argmax(axis=1), each.max(axis=1)
    return best, top, top - np.partition(each, -2, axis=1)[:, -2] if each.shape[1] > 1 else top


@dataclass
class Centroids:
    langs: list[str]  # sorted
    starts: list[int]  # each language's first row of vectors
    vectors: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # least cosine by log2 of the number of n-grams
    leads: np.ndarray  # least lead over the next language, likewise

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for at in range(0, len(texts), 256):
            counts, n = _counts(texts[at : at + 256])
            if not self.langs:
                out += [("und", 0.0, True)] * len(n)
                continue
            best, top, lead = _nearest(_unit(counts, self.idf) @ self.vectors.T, self.starts)
            far = (top < self.floors[_bucket(n)]) | (lead < self.leads[_bucket(n)])
            for m, b, s, r in zip(n, best, top, far, strict=True):
                out.append((self.langs[b], float(min(max(s, 0.0), 1.0)), bool(r)) if m else ("und", 0.0, True))
        return out


def _packed(g: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(np.bincount(g, minlength=DIM), 65535).astype(np.uint16).tobytes(), 1)


def _unpacked(rows: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(zlib.decompress(x), dtype=np.uint16) for x in rows], dtype=np.float32).reshape(-1, DIM)


def _floors(quantiles: dict[int, tuple[float, float]]) -> np.ndarray:
    """Floors by length from the low quantile of known texts and the high one of foreign texts of some lengths; other lengths take the next one's, less by the root of two for each halving."""
    at = {b: high + NEAR * (low - high) if high < low else low for b, (low, high) in quantiles.items()}
    near = [min(at, key=lambda x: abs(x - b), default=None) for b in range(64)]
    return np.array([0.0 if k is None else at[k] * 2.0 ** (min(0, b - k) / 2) for b, k in enumerate(near)])


def fit(docs: DataFrame, clusters: int = 4, sample: int = 800, error: float = 0.002, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Centroids:
    """Centroids from rows with a language. Document frequencies count all rows; centroids and floors are fitted on about `sample` rows a language, chosen by a hash.

    A fourth of the sample sets the floors and has no part in the centroids: whole texts, and a piece of each length in PIECES of each text.
    A text is known with all centroids, and foreign with all but those of its own language. For texts of a length (log2 of the number of n-grams)
    there are two floors, of the cosine to the nearest language and of its lead over the next one. Each lies below all but `error` of the known texts
    and above FOREIGN of the foreign ones: where that is possible, NEAR of the way up from these, and else at the lower end, so that
    known languages are kept. With fewer than three languages, foreign texts have no lead, and there is no floor for it.

    Each language's centroids are made in a task of their own from its part of the sample; the driver gets centroids, frequencies and quantiles alone.
    Without a row to learn from, everything is `und` and rejected. Repeated rows count once in the sample; over MOST_LANGUAGES languages are an error.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, dtype=np.int64), np.arange(DIM + 1)
        for b in batches:
            for t in b.column(0).to_pylist():
                if (g := grams(t)) is not None:
                    df[:DIM] += np.bincount(g, minlength=DIM) > 0
                    df[DIM] += 1
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(df)], names=["gram", "n"])

    df = np.zeros(DIM + 1)
    for gram, n in docs.select("text").mapInArrow(frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():  # DIM + 1 rows at most
        df[gram] = n
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])).astype(np.float32) + np.float32(0.05)

    sizes = stored(docs.groupBy("lang").count(), "languages")
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    few = docs.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(sizes), "lang")  # MOST_LANGUAGES rows
    few = few.filter(F.pmod(F.col("h"), F.lit(1_000_003)) * F.col("count") < F.lit(sample * 1_000_003)).dropDuplicates(["h", "lang"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cut = [(k, h % (len(text) - k + 1)) for k in PIECES if k < len(text)]
                rows += [(lang, h, k, g) for k, g in [(0, grams(text)), *((k, grams(text[i : i + k])) for k, i in cut)] if g is not None]
            made = [(lang, h, k, len(g), _packed(g)) for lang, h, k, g in rows]
            types = {"lang": pa.string(), "h": pa.int64(), "piece": pa.int64(), "n": pa.int64(), "v": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(types.values())], names=list(types))

    def clustered(rows: pd.DataFrame) -> pd.DataFrame:
        """Of one language: centroids (piece -1), and what sets the floors as it came."""
        whole = rows[rows.piece == 0].sort_values("h")
        kept = np.arange(len(whole)) % 4 != 3
        c = _clusters(_unit(_unpacked(list(whole.v[kept])), idf), clusters)
        made = pd.DataFrame({"lang": rows.lang.iloc[0], "h": np.arange(len(c)), "piece": -1, "n": 0, "v": [x.tobytes() for x in c]})
        return pd.concat([made, rows[rows.h.isin(whole.h[~kept])]])

    kinds = "lang string, h long, piece long, n long, v binary"
    learnt = stored(few.select("lang", "h", "text").mapInArrow(packed, kinds).groupBy("lang").applyInPandas(clustered, kinds), "centroids")
    found = learnt.filter("piece = -1").orderBy("lang", "h").collect()  # `clusters` rows a language
    langs = sorted({r.lang for r in found})
    if not langs:
        return Centroids([], [], np.zeros((0, DIM), np.float32), idf, np.zeros(64), np.zeros(64))
    vectors = np.array([np.frombuffer(r.v, dtype=np.float32) for r in found])
    owners = np.searchsorted(langs, [r.lang for r in found])
    starts = np.searchsorted(owners, np.arange(len(langs))).tolist()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, n, v = (b.column(k).to_pylist() for k in range(3))
            for at in range(0, len(v), 256):
                cos = _unit(_unpacked(v[at : at + 256]), idf) @ vectors.T
                _, top, lead = _nearest(cos, starts)
                cos[owners[None, :] == np.searchsorted(langs, lang[at : at + 256])[:, None]] = 0
                _, other, its_lead = _nearest(cos, starts)
                values = [_bucket(np.array(n[at : at + 256], dtype=np.int64)), *(x.astype(float) for x in (top, lead, other, its_lead))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["b", "top", "lead", "other", "its_lead"])

    judges = learnt.filter("piece >= 0").select("lang", "n", "v").mapInArrow(judged, "b long, top double, lead double, other double, its_lead double")
    low, high = F.lit(error), F.lit(FOREIGN)
    rows = judges.groupBy("b").agg(F.count("*").alias("n"), *(F.percentile(c, q).alias(c) for c, q in (("top", low), ("lead", low), ("other", high), ("its_lead", high)))).filter("n >= 10").collect()  # 64 rows at most
    floors = _floors({r.b: (r.top, r.other) for r in rows})
    leads = _floors({r.b: (r.lead, r.its_lead) for r in rows}) if len(langs) > 2 else np.zeros(64)
    return Centroids(langs, starts, vectors, idf, floors, leads)


def identify(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (cosine to the nearest centroid, 0 to 1) and lang_rejected (nearer to none than the floor for its length, or hardly nearer to one than to the next).

    A text that is null or has no letter is `und` with score 0 and rejected. Whole texts count, however long; equal texts get equal
    results; of equally near languages the first by name counts; an empty table gives an empty result. Columns of docs that have these names are replaced.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, lang_score double, lang_rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict(list(text)), columns=["lang_pred", "lang_score", "lang_rejected"]).astype({"lang_score": float, "lang_rejected": bool})

    new = ["lang_pred", "lang_score", "lang_rejected"]
    keep, made = others(docs, new), fresh("lang", docs)
    d = docs.select(*keep, predict(F.col(text_col)).alias(made))
    return d.select(*keep, *(F.col(made)[c].alias(c) for c in new))
