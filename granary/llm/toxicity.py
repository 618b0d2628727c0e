"""Toxicity by multiple-instance learning: a document is toxic if at least one sentence is; only documents have labels."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fresh, others, small_batches

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


@dataclass
class SentenceModel:
    """z of a sentence is bias + weights of its distinct words, and its probability the logistic function of z.

    Documents combine them by noisy-or with a leak: -log(1 - P) is softplus(bias) once for the document and, for each sentence, what
    softplus(z) exceeds the background by, softplus(bias + margin). So sentences without evidence add nothing, however many there are.
    """

    bias: float
    weights: dict[str, float]
    margin: float = 1.0

    def sentences(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """The document's score, its number of sentences, and (start, end, probability) of those over one half."""
        n, found, known, weights, bias = 0, [], self.weights.keys(), self.weights, self.bias
        total, quiet = math.log1p(math.exp(bias)), math.log1p(math.exp(bias + self.margin))
        for m in SENTENCE.finditer(text or ""):
            if m[0].isspace():
                continue
            n += 1
            hit = known & set(WORD.findall(m[0].lower()))
            if not hit:
                continue
            z = bias + sum(weights[w] for w in sorted(hit))
            total += max(0.0, max(z, 0.0) + math.log1p(math.exp(-abs(z))) - quiet)
            if z > 0:
                found.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
        return -math.expm1(-total) if n else 0.0, n, found


def _train(texts: list[str], toxic: np.ndarray, min_docs: int, rounds: int, decay: float, least_z: float, margin: float, rate: float = 1.0) -> SentenceModel:
    # Words are numbers from here on: texts of objects would take many times the memory.
    number: dict[str, int] = {}
    docs: list[list[np.ndarray]] = []
    for t in texts:
        docs.append([np.array(sorted({number.setdefault(w, len(number)) for w in WORD.findall(s.lower())}), np.int32) for s in SENTENCE.findall(t) if not s.isspace()])
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    df, bad = np.zeros(len(number)), np.zeros(len(number))
    for d, t in zip(docs, toxic.tolist(), strict=True):
        own = np.unique(np.concatenate(d)) if d else np.zeros(0, np.int32)
        df[own] += 1
        bad[own] += t
    a, b = bad + 0.5, df - bad + 0.5
    telling = (df >= min_docs) & (np.abs(np.log(a / (n1 + 1) * (n0 + 1) / b)) >= least_z * np.sqrt(1 / a + 1 / b))
    vocabulary = [w for w, i in number.items() if telling[i]]
    at = np.full(len(number), -1)
    at[telling] = np.arange(int(telling.sum()))
    kept = [at[s] for d in docs for s in d]
    kept = [s[s >= 0] for s in kept]
    word = np.concatenate([*kept, np.zeros(0, int)]).astype(int)
    sentence = np.repeat(np.arange(len(kept)), [len(s) for s in kept])
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    w, b = np.clip(np.log(a / (n1 + 1) * (n0 + 1) / b)[telling], -4, 6), -6.0  # a word that tells starts above the margin, else it would have no gradient
    gw, gb = np.full(len(vocabulary), 1e-8), 1e-8  # AdaGrad
    for _ in range(rounds):
        z = b + np.bincount(sentence, weights=w[word], minlength=len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        quiet, active = np.logaddexp(0, b + margin), z > b + margin
        s = np.logaddexp(0, b) + np.bincount(doc, weights=np.where(active, np.logaddexp(0, z) - quiet, 0.0), minlength=len(texts))
        pull = np.where(toxic, 1 / np.expm1(np.clip(s, 1e-6, 40)), -1.0)  # d log-likelihood / d s
        g = pull[doc] * p * active
        leak = lambda x: 1 / (1 + math.exp(-x))
        db = g.sum() - (pull[doc] * active).sum() * leak(b + margin) + pull.sum() * leak(b)
        dw, db = np.bincount(word, weights=g[sentence], minlength=len(w)) - decay * w, db - decay * (b + 6)
        gw, gb = gw + dw * dw, gb + db * db
        w, b = w + rate * dw / np.sqrt(gw), b + rate * db / math.sqrt(gb)
    return SentenceModel(float(b), margin=margin, weights={v: float(x) for v, x in zip(vocabulary, w, strict=True) if abs(x) > 0.05})


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000, max_chars: int = 200_000, min_docs: int = 5, least_z: float = 3.0, rounds: int = 150, decay: float = 0.02, margin: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> SentenceModel:
    """Trains on at most `sample` labelled documents of at most `max_chars` code points, chosen by a hash of the id; both bounds are only for training.

    Words count that `min_docs` of these have and whose log odds ratio between the classes is `least_z` standard errors from 0.

    The labels are a bounded set once chosen, so they are broadcast to find the texts. An id with several labels counts as
    toxic if one says so; of several texts with an id the largest is taken. Without both classes, as in empty tables, nothing scores over one half.
    """
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.char_length("_text") <= max_chars).join(F.broadcast(chosen), "_id")
    rows = sorted(tuple(r) for r in texts.groupBy("_id").agg(F.max("_text"), F.max("_toxic")).collect())  # `sample` rows at most
    toxic = np.array([r[2] > 0 for r in rows], bool)
    if not toxic.any() or toxic.all():
        return SentenceModel(-6.0, {})
    return _train([r[1] for r in rows], toxic, min_docs, rounds, decay, least_z, margin)


def score(docs: DataFrame, model: SentenceModel, text_col: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1, of the whole text), n_sentences and toxic_spans: start, end and probability of each sentence that is over one half.

    A sentence ends at . ! ? or a line's end, and blanks alone are none; spans count code points. Null and empty texts have no sentence and score 0.
    Very long texts are scored whole; equal texts get equal scores, and ties stay ties; an empty table gives an empty result.
    Columns of docs that have these names are replaced.
    """
    new = ["toxicity", "n_sentences", "toxic_spans"]

    small_batches(docs.sparkSession)

    @F.pandas_udf("toxicity double, n_sentences long, toxic_spans array<struct<start:long,end:long,p:double>>")
    def scored(text: pd.Series) -> pd.DataFrame:
        rows = [model.sentences(t) for t in text]
        return pd.DataFrame({"toxicity": [float(r[0]) for r in rows], "n_sentences": [r[1] for r in rows], "toxic_spans": [[{"start": a, "end": b, "p": p} for a, b, p in r[2]] for r in rows]})

    keep, made = others(docs, new), fresh("toxicity", docs)
    d = docs.select(*keep, scored(F.col(text_col)).alias(made))
    return d.select(*keep, *(F.col(made)[c].alias(c) for c in new))
