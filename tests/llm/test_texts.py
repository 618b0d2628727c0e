"""Periodic runs, fingerprints and fill-in-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import fill_in_middle as fim
from granary.llm import multiset_hash, periodic_runs, queries
from granary.llm.common import table
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def naive_runs(words, least=24, repeats=3):
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q) and not any(s <= i and s + m >= j + q and q % p == 0 for s, m, p in found):
                found.append((i, j - i + q, q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed, count):
    rnd = random.Random(seed)
    out = ["", None, " ", "a " * 23, "a " * 24, "a " * 500, "a b " * 12 + "a", " ".join(map(str, range(100))) + " x" * 24]
    for _ in range(count):
        words = []
        for _ in range(rnd.randint(1, 5)):
            unit = [rnd.choice("abc") for _ in range(rnd.choice((1, 2, 3, 5, 8, 9, 16, 17, 20, 33, 40)))]
            words += (unit * rnd.randint(1, 8))[: rnd.randint(1, 200)] + [rnd.choice("abcd") for _ in range(rnd.randint(0, 5))]
        out.append(rnd.choice((" ", "\n", "\t ")).join(words))
    return out


@pytest.mark.parametrize("least,repeats", [(24, 3), (6, 3), (10, 5), (1, 4)])
def test_runs_are_those_of_brute_force(spark, least, repeats):
    texts = random_texts(least, 150)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.find_runs(d, least, repeats).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        want = naive_runs(words, least, repeats)
        assert [tuple(r) for r in got[i].runs] == want and got[i].n_words == len(words) and got[i].collapsed_text == collapsed(words, want)


def test_runs_over_slices_of_words_and_texts(spark, monkeypatch):
    texts = random_texts(9, 40)
    monkeypatch.setattr(periodic_runs, "PIECE", 7)
    table_ = {}

    class Numbers(dict):
        def __missing__(self, k):
            return table_.setdefault(k, len(table_))

    for t in texts:
        assert [list(table_)[c].decode() for c in periodic_runs.codes_of((t or "").encode(), Numbers())] == WORD.findall(t or "")
    with pytest.raises(ValueError):
        periodic_runs.find_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), repeats=2)


def test_runs_best_is_exact(spark):
    d = spark.sql("SELECT array(named_struct('start', 0L, 'length', 100L, 'period', 33L), named_struct('start', 5L, 'length', 30L, 'period', 9L), named_struct('start', 6L, 'length', 60L, 'period', 18L)) AS runs")
    assert d.select(periodic_runs.best_run(F.col("runs")).alias("b")).first().b.asDict() == {"start": 5, "length": 30, "period": 9}
    assert d.select(periodic_runs.best_run(F.slice("runs", 1, 0)).alias("b")).first().b is None


def test_op11_planted(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert sorted(got) == sorted(docs)
    planted = 0
    for i, text in docs.items():
        words, h = WORD.findall(text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        if len(words) < 1500:
            runs = naive_runs(words)
            assert got[i].n_runs == len(runs) and got[i].runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)) and got[i].collapsed_sha256 == sha(collapsed(words, runs))
    assert planted


# Fingerprints


def test_fingerprints_are_sums_of_paragraphs():
    a, b, c, empty = "One two three four.", "Another line\nand more of it", "é" * 50, ""
    s = multiset_hash.sums([f"{a}\n{b}\n{c}", f"{c}\n{b}\n{a}", a, b, c, f"{a}\n\n{b}\n{c}\n", empty, f"{a}\n{a}"])
    one = s.to_bytes()
    assert one[0] == one[1] == one[5] and len(set(one)) == 6 and len(one[0]) == multiset_hash.SIZE
    assert (s[2:3] + s[3:4] + s[4:5]).to_bytes() == one[:1] and (s[0:1] - s[2:3] - s[4:5]).to_bytes() == one[3:4]
    assert (s[2:3] + s[2:3]).to_bytes() == one[7:8] and (s[2:3] - s[2:3]).to_bytes() == one[6:7]
    assert multiset_hash.Sums.from_bytes(one).to_bytes() == one
    same = multiset_hash.sums(["w1 w2 w3 w1 w2 " * 500] * 2)
    assert same[:1].likeness(same[1:]).tolist() == [1.0]


def shingle_counts(text):
    out = Counter()
    for line in text.split("\n"):
        w = WORD.findall(line)
        out.update(tuple(w[i : i + 3]) for i in range(max(len(w) - 2, min(len(w), 1))))
    return out


def cosine(a, b):
    a, b = shingle_counts(a), shingle_counts(b)
    norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return sum(v * b[k] for k, v in a.items()) / norm if norm else 0.0


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def checked(rows, spark):
    """What against_next gives for rows, held against the definition; the largest error of a likeness."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    order = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h")).collect()
    order = sorted(order, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want, worst = [], 0.0
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        want.append((r.doc_id, len(r.text), edited(r.text, n.text), r.text, n.text))
    prints = dict(zip([w[3] for w in want] + [w[2] for w in want], multiset_hash.sums([w[3] for w in want] + [w[2] for w in want]).to_bytes(), strict=True))
    got = multiset_hash.against_next(d).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:3] == w[:3] and bytes(g.fingerprint) == prints[w[3]] and bytes(g.edited_fingerprint) == prints[w[2]]
        for near, other in ((g.near_edited, w[2]), (g.near_next, w[4])):
            assert 0 <= near <= 1
            worst = max(worst, abs(near - (1 if prints[w[3]] == prints[other] else cosine(w[3], other))))
    return worst


def test_against_next_awkward_and_tiny(spark):
    assert checked([(r.doc_id, r.text) for r in cases.docs(spark).collect()], spark) < 0.5
    assert checked([(1, "alone in the table\nwith two lines")], spark) < 0.5
    assert multiset_hash.against_next(cases.docs(spark).limit(0)).isEmpty()
    assert multiset_hash.fingerprint(cases.docs(spark)).columns[-1] == "fingerprint" and multiset_hash.fingerprint(cases.docs(spark).limit(0)).isEmpty()


def test_against_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "RANGE_BYTES", 20_000)
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert checked(docs, spark) < 0.35
    hot = docs[:40] + [(7, "the same text in many rows")] * 150 + [(None, f"text {i % 3}") for i in range(60)]
    assert checked(hot, spark) < 0.35


def test_changed_and_likeness(spark):
    d = spark.createDataFrame([("a b c d\ne f g h", "new words here", "e f g h", "new words here\na b c d"), ("x", None, None, "x"), (None, "", "", "")], "text string, more string, less string, other string")
    d = multiset_hash.fingerprint(d).withColumn("new", multiset_hash.changed(F.col("fingerprint"), F.col("more"), F.col("less"))).withColumn("old", F.col("fingerprint"))
    d = multiset_hash.fingerprint(d, "other").withColumn("near", multiset_hash.likeness(F.col("new"), F.col("fingerprint")))
    assert [r.near for r in d.collect()] == [1.0] * 3
    assert d.select(multiset_hash.likeness(F.lit(None).cast("binary"), F.col("new")).alias("n")).first().n is None


# Fill-in-middle


def naive_fim(doc_id, text, marks=fim.MARKS):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    parts = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in marks) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    p, s, m = marks
    out = s + parts[2] + p + parts[0] + m + parts[1] if h[3] % 100 < 20 else p + parts[0] + s + parts[2] + m + parts[1]
    return len(tokens), "spm" if h[3] % 100 < 20 else "psm", len(parts[0]), len(parts[1]), out


@pytest.mark.parametrize("piece", [5, 1 << 20])
def test_fim_is_that_of_brute_force(piece, monkeypatch):
    monkeypatch.setattr(fim, "PIECE", piece)
    rnd = random.Random(piece)
    forms = Counter()
    for i in range(600):
        text = "".join(rnd.choice(("a", "b", "Z", " ", "\n", "é", "日", "😀", "<", "1", "word", "<S>" if i % 9 == 0 else "-")) for _ in range(rnd.randint(0, 60)))
        h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        got = fim.transform(text.encode(), tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8)))
        assert (*got[:4], got[4].decode()) == naive_fim(i, text)
        forms[got[1]] += 1
    assert min(forms.values()) > 30 and len(forms) == 3


def test_exceptions_convert_both_ways():
    for text in ("", "plain", "é日😀x", "aé", "日" * 40 + "a" * 40 + "😀"):
        data = text.encode()
        index = fim.Exceptions(np.frombuffer(data, np.uint8))
        assert index.n_chars == len(text)
        for c in range(len(text) + 1):
            assert index.to_bytes(c) == len(text[:c].encode())
        byte = 0
        for c, x in enumerate(text):
            for _ in x.encode():
                assert index.to_chars(byte) == c
                byte += 1


def test_fim_awkward_and_units(spark):
    docs = cases.docs(spark).union(cases.docs(spark).limit(1).withColumn("text", F.lit("holds <M> itself")))
    d = fim.restore(fim.fill_in_middle(docs))
    assert [c for c in d.columns if c in docs.columns] == docs.columns
    for r in d.collect():
        assert r.restored_text == (r.text or "") and (r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text) == naive_fim(r.doc_id, r.text or "")
    for unit in ("chars", "bytes"):
        marks = ("[p]", "[s]", "[m]")
        back = fim.restore(fim.fill_in_middle(docs, seed=7, unit=unit, rate=100, spm=50, marks=marks), marks)
        assert all(r.restored_text == (r.text or "") and r.fim_units == len((r.text or "") if unit == "chars" else (r.text or "").encode()) for r in back.collect())
    assert fim.restore(fim.fill_in_middle(docs.limit(0))).isEmpty()
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="lines")


def test_runs_awkward(spark):
    docs = cases.docs(spark)
    d = periodic_runs.find_runs(periodic_runs.planted(docs))
    assert [c for c in d.columns if c in docs.columns] == docs.columns and d.count() == docs.count()
    assert {r.n_words for r in d.filter("text is null").collect()} == {0}
    assert periodic_runs.find_runs(docs.limit(0)).isEmpty()
