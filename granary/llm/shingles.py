"""Sets of hashed word shingles of whole texts, made with numpy, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Of bytes: A-Z to a-z; and besides, ASCII signs to spaces.
CASE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PLAIN = bytes(c if b > 127 or chr(c).isalnum() else 32 for b, c in enumerate(CASE))
_WHITE = frozenset((32, 9, 10, 11, 12, 13))
_MULTIPLY = 0x9E3779B97F4A7C15  # odd, and so has an inverse
_RANDOM = np.random.default_rng(20240901).integers(1, 2**63, 256, dtype=np.uint64)
_PIECE = 1 << 18
_POWERS: list[np.ndarray] = []
_TABLES: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_MULTIPLY, pow(_MULTIPLY, -1, 2**64)):
            p = np.full(_PIECE + 1, base, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def _tables(case: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its random number after translation, and whether it is part of words."""
    if case not in _TABLES:
        to = np.frombuffer(case, np.uint8)
        _TABLES[case] = _RANDOM[to], np.array([b not in _WHITE for b in case])
    return _TABLES[case]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece(a: np.ndarray, stops: np.ndarray, case: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of at most _PIECE bytes; no word goes over one of stops, which are in order."""
    number, inside = _tables(case)
    word = inside[a]
    first = np.zeros(len(a) + 1, dtype=bool)  # a word begins here
    last = np.zeros(len(a) + 1, dtype=bool)  # a word has ended before here
    first[1:-1] = word[1:] & ~word[:-1]
    last[1:-1] = ~word[1:] & word[:-1]
    if len(a):
        first[0], last[-1] = word[0], word[-1]
    cut = stops[(stops > 0) & (stops < len(a))]
    first[cut] |= word[cut]
    last[cut] |= word[cut - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _powers()
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(number[a] * power[: len(a)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin]), begin


def _long(a: np.ndarray, case: bytes) -> np.ndarray:
    """Word hashes of a text of at least _PIECE bytes, in pieces cut at white space; a word of at least that size is hashed by its pieces, wherever it stands."""
    inside, out, at, none = _tables(case)[1], [], 0, np.zeros(0, np.int64)
    while at < len(a):
        end = min(at + _PIECE, len(a))
        if end == at + _PIECE:
            gaps = np.flatnonzero(~inside[a[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1 if end < len(a) else end
            else:
                h = np.zeros(1, np.uint64)
                while at < len(a) and inside[a[at]]:
                    part = a[at : at + _PIECE]
                    gaps = np.flatnonzero(~inside[part])
                    part = part[: gaps[0]] if len(gaps) else part
                    h = mix(h * np.uint64(31) + _piece(part, none, case)[0])
                    at += len(part)
                out.append(h)
                continue
        out.append(_piece(a[at:end], none, case)[0])
        at = end
    return np.concatenate(out)


def each_words(texts: pa.Array, case: bytes = CASE) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of each text, in order; none for null. Bytes are translated by `case` first."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _PIECE - 1, "right")) - 1
        j = min(max(j, i), n)
        if j == i:
            yield _long(data[offsets[i] : offsets[i + 1]], case)
            i += 1
            continue
        at = offsets[i : j + 1] - offsets[i]
        hashes, begin = _piece(data[offsets[i] : offsets[j]], at, case)
        edge = np.searchsorted(begin, at)
        for k in range(j - i):
            yield hashes[edge[k] : edge[k + 1]]
        i = j


def word_hashes(text: str | None, case: bytes = CASE) -> np.ndarray:
    return next(each_words(pa.array([text], pa.large_string()), case))


def shingles_of(w: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of the whole sequence if it has fewer words; empty without words."""
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[i : n + i]
    h = mix(h)
    h.sort()
    new = np.ones(n, dtype=bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def each_set(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    for w in each_words(texts):
        yield shingles_of(w, k)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    return shingles_of(word_hashes(text), k)
