"""Fill-in-middle: texts are cut in three, and the middle is moved to the end, after marks that tell the parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fresh, others, small_batches

MARKS = ("<P>", "<S>", "<M>")
UNITS = ("tokens", "chars", "bytes")
#: Bytes of a text whose tokens are looked at together.
PIECE = 1 << 20
MADE = ("fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text")


class Exceptions:
    """The characters of a UTF-8 text that have more than one byte: where they begin, and the excess bytes up to there.

    Between them a character is a byte, so cuts are converted by looking up the exceptions before them and adding; a text that is all
    ASCII has none. They are 16 bytes for each such character.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.size = len(data)
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.before = np.zeros(len(self.at) + 1, np.int64)  # excess bytes of the exceptions before each, and of all
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=self.before[1:])
        self.chars = self.at - self.before[:-1]  # where they are, in code points

    @property
    def n_chars(self) -> int:
        return self.size - int(self.before[-1])

    def to_bytes(self, char: int) -> int:
        """The byte at which a code point begins."""
        return char + int(self.before[np.searchsorted(self.chars, char, "left")])

    def to_chars(self, byte: int) -> int:
        """The code point that a byte belongs to."""
        k = int(np.searchsorted(self.at, byte, "right"))  # exceptions that begin at or before the byte
        if k and byte <= self.at[k - 1] + self.before[k] - self.before[k - 1]:
            return int(self.chars[k - 1])
        return byte - int(self.before[k])


def _starts(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Where in data[begin:end] tokens begin: runs of ASCII letters, and all other code points."""
    part = data[max(begin - 1, 0) : end]
    letter = ((part | 32) - np.uint8(97)) < 26
    start = (part & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start[1:] if begin else start) + begin


def token_cuts(data: np.ndarray, draws: tuple[int, int]) -> tuple[int, list[int]]:
    """The number n of tokens, and the bytes before which draw % (n + 1) tokens lie. Tokens are counted piece by piece."""
    pieces = range(0, len(data), PIECE)
    if len(pieces) == 1:
        starts = _starts(data, 0, len(data))
        n = len(starts)
        return n, [int(starts[k]) if (k := d % (n + 1)) < n else len(data) for d in draws]
    ends = np.cumsum([len(_starts(data, p, min(p + PIECE, len(data)))) for p in pieces]) if len(data) else np.zeros(1, np.int64)
    n, out = int(ends[-1]), []
    for d in draws:
        k = d % (n + 1)
        i = int(np.searchsorted(ends, k, "right"))
        out.append(int(_starts(data, pieces[i], min(pieces[i] + PIECE, len(data)))[k - (int(ends[i - 1]) if i else 0)]) if k < n else len(data))
    return n, out


def cuts(data: np.ndarray, draws: tuple[int, int], unit: str) -> tuple[int, list[int], list[int]]:
    """(number of units, both cuts in bytes, in code points), the smaller first."""
    index = Exceptions(data)
    if unit == "tokens":
        n, at = token_cuts(data, draws)
        at.sort()
        return n, at, [index.to_chars(b) if b < len(data) else index.n_chars for b in at]
    n = index.n_chars if unit == "chars" else len(data)
    k = sorted(d % (n + 1) for d in draws)
    chars = k if unit == "chars" else [index.to_chars(b) if b < len(data) else index.n_chars for b in k]
    return n, [index.to_bytes(c) for c in chars], chars


def transform(text: bytes, draws: tuple[int, int, int, int], unit: str = "tokens", rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    data = np.frombuffer(text, np.uint8)
    n, at, chars = cuts(data, draws[:2], unit)
    p, s, m = (x.encode() for x in marks)
    if not text or draws[2] % 100 >= rate or any(x in text for x in (p, s, m)):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[: at[0]], text[at[0] : at[1]], text[at[1] :]
    if draws[3] % 100 < spm:
        return n, "spm", chars[0], chars[1] - chars[0], b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", chars[0], chars[1] - chars[0], b"".join((p, prefix, s, suffix, m, middle))


def draws_of(id_: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of seed and id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "tokens", rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with fim_units (the text's tokens, chars or bytes), fim_form, fim_prefix_chars, fim_middle_chars and fim_text.

    `rate` percent of the texts are cut before two random units into prefix, middle and suffix: `psm` texts are prefix, suffix and middle, each after
    its mark, and `spm` percent of them are suffix, prefix and middle instead. Tokens are runs of ASCII letters and all other code points; cuts in bytes
    fall before the code point that they hit. Empty texts and those that hold a mark stay as they are (`plain`).

    Null texts are empty. Very long texts are cut whole, and their tokens counted by pieces. Rows that repeat id and text give equal results, as does a
    rerun; two cuts at the same place leave the middle empty. An empty table gives an empty result. Columns with these five names are replaced, others stay.
    """
    if unit not in UNITS:
        raise ValueError(f"no unit {unit!r}; there are {', '.join(UNITS)}")
    small_batches(docs.sparkSession)

    @F.arrow_udf("units long, form string, prefix_chars long, middle_chars long, text string")
    def cut(text: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        draws = zip(*(x.to_pylist() for x in (a, b, c, d)), strict=True)
        rows = [transform(t or b"", r, unit, rate, spm, marks) for t, r in zip(text.cast(pa.binary()).to_pylist(), draws, strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()
        made = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
        made[4] = made[4].view(pa.string())
        return pa.StructArray.from_arrays(made, ["units", "form", "prefix_chars", "middle_chars", "text"])

    at = fresh("fim", docs)
    d = docs.withColumn(at, cut(F.col(text_col), *draws_of(F.col(id_col), seed)))
    return d.select(*others(docs, MADE), *(F.col(at)[n.removeprefix("fim_")].alias(n) for n in MADE))


def restore(df: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """df, which has fim_text and fim_form, with the text that was cut as `restored_text`: the parts between the marks in their order. A null output stays null."""
    parts = F.split("fim_text", "|".join(rf"\Q{m}\E" for m in marks), -1)
    d = df.select(*others(df, ("restored_text",)), parts.alias(at := fresh("parts", df)))
    order = F.when(F.col("fim_form") == "psm", F.concat(*(F.get(at, F.lit(i)) for i in (1, 3, 2)))).when(F.col("fim_form") == "spm", F.concat(*(F.get(at, F.lit(i)) for i in (2, 3, 1))))
    return d.withColumn("restored_text", F.when(F.col("fim_form") == "plain", F.col("fim_text")).otherwise(order)).drop(at)
