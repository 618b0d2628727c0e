"""Quality rules: counts of words, symbols and repetition, and the fertility of public tokenizers."""

from __future__ import annotations

import base64
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WHITE, fresh, others, pieces_of, small_batches, stored

_IS_WORD = np.array([chr(b) not in WHITE for b in range(256)])
_IS_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
TOKENIZERS = "/opt/tokenizers"
#: Splits text for the rank vocabularies: letters, numbers or other signs, each with one space before.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a Python worker remembers; beyond that it forgets all and starts anew. Only speed depends on it.
REMEMBER = 400_000
#: Bands that are broadcast at most.
MOST_SENT = 100_000
#: Bytes of text that are counted in one go; a longer text is one go by itself.
BATCH_BYTES = 8_000_000
#: Robust deviations from the median beyond which a measure is rejected, least deviations as shares of the median, and different texts that a group needs for bands of its own.
SPREAD, LEAST_SPREAD, LEAST_TEXTS = 4.0, {"chars_per_token": 0.015, "token_entropy": 0.02}, 200


@dataclass(frozen=True)
class Bands:
    """The widest bands, whatever the documents are like; for texts under `least_tokens` only the byte share is looked at."""

    chars_per_token: tuple[float, float] = (1.1, 9.0)
    most_byte_share: float = 0.3
    least_entropy: float = 2.5
    least_tokens: int = 50


@dataclass(frozen=True)
class Rules:
    """Bands by the script that most letters are of. Vocabularies of mostly Latin tokens cut other scripts finer, so their bands differ."""

    default: Bands = Bands(chars_per_token=(0.25, 9.0), most_byte_share=0.95)
    by_script: dict[str, Bands] = field(default_factory=lambda: {"latin": Bands(), "greek": Bands((0.5, 9.0), 0.6), "cyrillic": Bands((0.8, 9.0), 0.5)})


@dataclass
class Batch:
    """The words of many texts: bytes, where each text begins among them, words as numbers of a dictionary, and each word's text."""

    data: np.ndarray
    begin: np.ndarray
    inside: np.ndarray  # for each place, bytes of words before it
    words: np.ndarray
    of: np.ndarray
    distinct: list[str]

    @property
    def n(self) -> int:
        return len(self.begin) - 1

    def total(self, marks: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        before = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return before[self.begin[1:]] - before[self.begin[:-1]]

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        return np.bincount(self.of, weights=values, minlength=self.n)


def _strings(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Strings that lie one after another in data."""
    return pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def read(texts: pa.Array) -> Batch:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
    begin = begin - begin[0]
    is_word = _IS_WORD[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    cut = begin[begin < len(data)]
    first[cut] = is_word[cut]
    at = np.flatnonzero(first)
    inside = np.concatenate(([0], np.cumsum(is_word, dtype=np.int64)))
    words = _strings(data[is_word], np.concatenate((inside[at], inside[-1:]))).dictionary_encode()
    return Batch(data, begin, inside, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(begin, at, "right") - 1, words.dictionary.to_pylist())


def repeated_lines(b: Batch) -> np.ndarray:
    """Lines with a word that equal an earlier line, of each text."""
    end = b.data == 10
    at = np.sort(np.concatenate((b.begin[:-1], np.flatnonzero(end) + 1)))
    stop = np.append(at[1:], len(b.data))
    some = np.flatnonzero(b.inside[stop] > b.inside[at])
    before = np.concatenate(([0], np.cumsum(~end, dtype=np.int64)))
    lines = _strings(b.data[~end], np.append(before[at], before[-1])).take(pa.array(some)).dictionary_encode()
    of = np.searchsorted(b.begin, at[some], "right") - 1
    once = np.unique(of * (len(lines.dictionary) + 1) + lines.indices.to_numpy(zero_copy_only=False))
    return np.bincount(of, minlength=b.n) - np.bincount(once // (len(lines.dictionary) + 1), minlength=b.n)


def repeated_words(b: Batch) -> np.ndarray:
    """Words in 5-word windows that a text has more than once. Windows with equal hashes are compared word by word."""
    at = np.flatnonzero(b.of[:-4] == b.of[4:]) if len(b.of) > 4 else np.zeros(0, np.int64)
    h = (b.of[at] + 1).astype(np.uint64)
    for k in range(5):
        h = (h ^ (b.words[at + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    s = np.sort(h)
    at = at[np.isin(h, np.unique(s[1:][s[1:] == s[:-1]]))]
    edge = np.zeros(len(b.of) + 1, np.int64)
    if len(at):
        rows = np.stack([b.of[at], *(b.words[at + k] for k in range(5))], axis=1)
        _, which, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = at[n[which.ravel()] > 1]
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 5, -1)
    return b.by_text(np.cumsum(edge)[:-1] > 0).astype(np.int64)


class Fertility:
    """Tokens of words by two public vocabularies: one of pieces with byte fallback, one of byte ranks. Made in each Python worker from the files' bytes; it remembers words."""

    def __init__(self, pieces: bytes, ranks: bytes) -> None:
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=table, special_tokens={})
        self.size = self.sp.get_piece_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.size)])
        self.width = np.zeros(max(table.values()) + 1, np.int64)  # bytes of each rank token
        for token, rank in table.items():
            self.width[rank] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens = [np.zeros(0, np.int64)]
        self.facts = [np.zeros((0, 3 + len(SCRIPTS)), np.int64)]  # of each word: piece tokens, byte tokens among them, rank tokens, letters of each script

    def learn(self, words: Sequence[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        pieces = self.sp.encode(new, num_threads=1)
        n = np.fromiter(map(len, pieces), np.int64, len(new))
        tokens = np.fromiter(chain.from_iterable(pieces), np.int64, int(n.sum()))
        of = np.repeat(np.arange(len(new)), n)
        # All words with a space before each are one text: a token belongs to the word that its first byte stands in.
        begin = np.cumsum([0, *(len(w.encode()) + 1 for w in new)])
        ranks = np.array(self.bpe.encode_ordinary(" " + " ".join(new)), np.int64)
        at = np.cumsum(self.width[ranks]) - self.width[ranks]
        ranks_of = np.bincount(np.searchsorted(begin, at, "right") - 1, minlength=len(new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.tokens.append(tokens)
        self.facts.append(np.column_stack((n, np.bincount(of[self.is_byte[tokens]], minlength=len(new)), ranks_of, script_letters(new))))

    def measure(self, b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: piece tokens, byte tokens among them, rank tokens, the entropy of the piece tokens in bits, and letters by script."""
        if len(self.known) > REMEMBER:
            self.forget()
        self.learn(b.distinct)
        self.tokens, self.facts = [np.concatenate(self.tokens)], [np.concatenate(self.facts)]
        at = np.fromiter(map(self.known.__getitem__, b.distinct), np.int64, len(b.distinct))
        begin, facts = np.concatenate(([0], np.cumsum(self.facts[0][:, 0]))), self.facts[0][at, 1:]
        first, length = begin[at][b.words], np.diff(begin)[at][b.words]
        pieces = b.by_text(length)
        end = np.cumsum(length)
        token = self.tokens[0][np.repeat(first - end + length, length) + np.arange(end[-1] if len(end) else 0)]
        key = np.sort(np.repeat(b.of, length) * self.size + token)
        run = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
        n = np.diff(np.append(run, len(key)))
        own = np.bincount(key[run] // self.size, weights=n * np.log2(n), minlength=b.n)
        entropy = np.where(pieces > 0, np.log2(np.maximum(pieces, 1)) - own / np.maximum(pieces, 1), 0.0)
        letters = np.stack([b.by_text(facts[:, 2 + k][b.words]) if facts[:, 2 + k].any() else np.zeros(b.n) for k in range(len(SCRIPTS))], axis=1)
        return pieces, b.by_text(facts[:, 0][b.words]), b.by_text(facts[:, 1][b.words]), np.maximum(entropy, 0.0), letters


# Code points where scripts begin and end.
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x6FF), "indic": (0x900, 0xDFF), "thai": (0xE00, 0xE7F), "hangul": (0xAC00, 0xD7AF), "kana": (0x3040, 0x30FF), "han": (0x4E00, 0x9FFF)}


def script_letters(words: Sequence[str]) -> np.ndarray:
    """How many letters of each script each word has."""
    a = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.stack([np.bincount(of[(a >= low) & (a <= high)], minlength=len(words)) for low, high in SCRIPTS.values()], axis=1)


_MADE: dict[str, Fertility] = {}
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, kept boolean"


def measure(docs: DataFrame, rules: Rules | None = None, tokenizers: str = TOKENIZERS, text_col: str = "text") -> DataFrame:
    """docs with counts and token measures of the whole text, in one pass; `kept` says so far that neither base rules nor the fixed bands of `rules` fail."""
    rules = rules or Rules()
    small_batches(docs.sparkSession)
    with open(f"{tokenizers}/piece_bpe_32k.model", "rb") as a, open(f"{tokenizers}/byte_bpe_multi_50k.tiktoken", "rb") as b:
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = np.array([*SCRIPTS, "none"])
    bands = [rules.by_script.get(k, rules.default) for k in kinds]

    def columns(f: Fertility, texts: pa.Array) -> list[np.ndarray]:
        b = read(texts)
        n, chars, repeat = np.bincount(b.of, minlength=b.n), b.total(_IS_WORD[b.data] & (b.data & 0xC0 != 0x80)), repeated_words(b)
        failed = (n < 10) | (100 * repeat > 20 * n)
        pieces, byte, ranks, entropy, letters = f.measure(b)
        kind = np.where(letters.any(axis=1), letters.argmax(axis=1), len(SCRIPTS))
        some = np.maximum(pieces, 1)
        cpt = np.where(pieces > 0, (chars / some + chars / np.maximum(ranks, 1)) / 2, 0.0)
        low, high, most_bytes, least_entropy, least_tokens = (np.array([x(band) for band in bands])[kind] for x in (lambda v: v.chars_per_token[0], lambda v: v.chars_per_token[1], lambda v: v.most_byte_share, lambda v: v.least_entropy, lambda v: v.least_tokens))
        fine = (byte <= most_bytes * pieces) & ((pieces < least_tokens) | (low <= cpt) & (cpt <= high) & (entropy >= least_entropy))
        return [n, chars, b.total(_IS_SYMBOL[b.data]), repeated_lines(b), repeat, failed, kinds[kind], pieces.astype(np.int64), cpt, np.where(pieces > 0, byte / some, 0.0), entropy, fine & ~failed]

    @F.arrow_udf(FIELDS)
    def assessed(texts: pa.Array) -> pa.Array:
        if tokenizers not in _MADE:
            _MADE[tokenizers] = Fertility(*files.value)
        parts = [columns(_MADE[tokenizers], t) for t in pieces_of(texts, BATCH_BYTES)]
        if not parts:
            parts = [columns(_MADE[tokenizers], texts)]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) if n == "script" else pa.array(c) for n, c in zip(names, cols, strict=True)], names=names)

    keep = others(docs, names)
    made = fresh("quality", docs)
    d = docs.select(*keep, assessed(F.col(text_col)).alias(made))
    return d.select(*keep, *(F.col(made)[c].alias(c) for c in names))


def _groups(measured: DataFrame, lang_col: str) -> DataFrame:
    """row (all columns of measured), lang and size, which doubles of tokens share."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in measured.columns else F.lit("")
    return measured.select(F.struct("*").alias("row"), lang.alias("lang"), F.length(F.bin("n_tokens")).alias("size"))


def fit(measured: DataFrame, rules: Rules | None = None, lang_col: str = "lang") -> DataFrame:
    """Bands (level, script, lang, size, low and high of each measure) from all documents that the base rules keep and that have enough tokens.

    Groups are of script, language and length (level 0), of script and language (1) and of script (3), each with at least LEAST_TEXTS
    texts; repeated texts count once, so a text with many copies makes no band narrow. A band ends SPREAD robust deviations below and
    above the median, each side by its own quartile; so up to about a fourth of a group may be junk.
    """
    d = _groups(measured, lang_col).filter(~F.col("row.base_failed") & (F.col("row.n_tokens") >= (rules or Rules()).default.least_tokens))
    d = d.select("row.script", "lang", "size", "row.n_tokens", *(F.round(f"row.{c}", 4).alias(c) for c in LEAST_SPREAD)).distinct()
    found = d.rollup("script", "lang", "size").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *(F.percentile_approx(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 10_000).alias(c) for c in LEAST_SPREAD))
    ends = []
    for c, least in LEAST_SPREAD.items():
        low, mid, high = (F.col(c)[i] for i in range(3))
        ends.append((mid - SPREAD * F.greatest((mid - low) / 0.6745, mid * least)).alias(f"{c}_low"))
        ends.append((mid + SPREAD * F.greatest((high - mid) / 0.6745, mid * least)).alias(f"{c}_high"))
    return found.filter((F.col("n") >= LEAST_TEXTS) & (F.col("level") < 7)).select("level", "script", "lang", "size", *ends)


def within(measured: DataFrame, bands: DataFrame, rules: Rules | None = None, lang_col: str = "lang") -> DataFrame:
    """measured, where kept asks too for the bands of the narrowest group that has some; both should be stored tables. There are a few hundred bands, but they grow with scripts and languages, so only small ones are sent to all tasks."""
    d = _groups(measured, lang_col)
    ends = [x for x in bands.columns if x.endswith(("_low", "_high"))]
    few = bands.count() <= MOST_SENT
    for level, keys in ((0, ("script", "lang", "size")), (1, ("script", "lang")), (3, ("script",))):
        own = bands.filter(F.col("level") == level).select(*(F.col(k).alias(f"{k}{level}") for k in keys), F.struct(*ends).alias(f"band{level}"))
        on = F.lit(True)
        for k in keys:
            on = on & ((F.col("row.script") if k == "script" else F.col(k)) == F.col(f"{k}{level}"))
        d = d.join(F.broadcast(own) if few else own, on, "left")
    band = F.coalesce(F.col("band0"), F.col("band1"), F.col("band3"))
    fine = [F.col(f"row.{c}").between(band[f"{c}_low"], band[f"{c}_high"]) for c in LEAST_SPREAD]
    kept = F.col("row.kept") & (band.isNull() | (F.col("row.n_tokens") < (rules or Rules()).default.least_tokens) | fine[0] & fine[1])
    return d.select(*(kept.alias(c) if c == "kept" else F.col("row")[c].alias(c) for c in measured.columns))


def assess(docs: DataFrame, rules: Rules | None = None, tokenizers: str = TOKENIZERS, text_col: str = "text", lang_col: str = "lang", drop_text: bool = False) -> DataFrame:
    """docs with counts, token measures and a verdict, all of the whole text. Columns with these names are replaced.

    base_failed: under 10 words, or over a fifth of the words stand in 5-word windows that occur again. kept: not base_failed,
    and the tokens are within the fixed bands of the text's script and the bands that all documents set for its script, language
    (where docs has lang_col) and length: characters per token (the mean of both vocabularies' figures) and the entropy of tokens,
    both two-sided; and by fixed bands the share of byte-fallback tokens. Tokens are those of single words, of any length.
    A null or empty text has no words and fails; very long texts count whole; repeated rows and ids get equal verdicts, each its own; ties can't occur; an empty table gives an empty result. The two vocabulary files (about 1 MB) are read on the driver and sent with the task.
    The measured rows are stored, without text if drop_text is set, so that texts are cut into tokens once.
    """
    measured = measure(docs, rules, tokenizers, text_col)
    measured = stored(measured.drop(text_col) if drop_text else measured, "quality")
    return within(measured, stored(fit(measured, rules, lang_col), "quality-bands"), rules, lang_col)
