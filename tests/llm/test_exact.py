"""Line dedup, mixing, n-gram join, PII and quality counts against brute-force versions; and the awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from granary.llm import line_dedup, mixing, ngram_join, pii, quality
from granary.llm.components import components
from granary.llm.shingles import shingle_set
from tests.llm import cases

WHITE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.docs(spark).cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def dedup(rows):
    """(text, lines, dropped) of each (id, text)."""
    key = lambda line: line.strip(WHITE).translate(LOWER)
    order = lambda i: math.inf if i is None else i
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    d = line_dedup.dedup_lines(docs)
    assert set(d.columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in d.collect()), key=str) == dedup(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).isEmpty()


def test_line_dedup_random(spark):
    r = random.Random(1)
    rows = [(i, "\n".join(r.choice(("Same line number ", " same LINE number ", "short", "")) + str(r.randrange(9)) for _ in range(r.randrange(6)))) for i in range(200)]
    d = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in d.collect()), key=str) == dedup(rows)


def targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [3, 1, 2] * len(sizes), strict=False))
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if unit * weights[s] > 2 * sizes[s]}
        if not over:
            return out | {s: unit * weights[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(2))
def test_mixing(spark, docs, seed):
    r = random.Random(seed)
    made = spark.createDataFrame([(i, cases.words(r.randrange(40)), r.choice(["a", "b", "b", "b", None, "d"])) for i in range(400)], "doc_id long, text string, source string")
    for d in (made, docs):
        sizes = Counter()
        for x in d.collect():
            sizes[x.source] += len(words(x.text))
        want, taken, n = targets(sizes), Counter(), 0
        out = mixing.mix(d).collect()
        for x in out:
            assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source]) and 0 <= x.taken <= 2 * x.size
            taken[x.source] += x.taken
            n += 1
        assert n == d.count() and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        assert sorted(out, key=str) == sorted(mixing.mix(d.repartition(3)).collect(), key=str)
    assert mixing.mix(docs.limit(0)).isEmpty()


def test_mixing_without_words(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(d).collect()] == [(0, 0.0, 0)] * 2


def joined(rows):
    """(id, shingles, component) by comparing all pairs."""
    def shingles(t):
        w = words((t or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets, up = [shingles(t) for _, t in rows], {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                up[y] = x
    return sorted((i, len(s), top(i)) for (i, _), s in zip(rows, sets, strict=True))


def test_ngram_join_random(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 3)
    r, rows = random.Random(3), []
    passage = cases.words(40, "p").split()
    for g in range(25):
        base = [f"{g}v{r.randrange(60)}" for _ in range(r.choice((3, 6, 12, 40, 120)))]
        for _ in range(r.choice((1, 2, 5))):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 12)):
                w[r.randrange(len(w))] = f"new{r.randrange(9)}"
            rows.append(" ".join(w + passage * (r.random() < 0.4)))
    rows = list(enumerate(rows, 100))
    d = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, d.collect())) == joined(rows)


def test_ngram_join_awkward(docs):
    rows = [(r.doc_id, r.text) for r in docs.filter("doc_id is not null").select("doc_id", "text").collect()]
    d = ngram_join.ngram_components(docs)
    assert sorted(tuple(r) for r in d.filter("doc_id is not null").collect()) == joined(rows)
    assert sorted((tuple(r) for r in d.filter("doc_id is null").collect()), key=str) == [(None, 0, None), (None, 56, None)]
    assert ngram_join.ngram_components(docs.limit(0)).isEmpty()


def test_signature_tree_keeps_all_pairs():
    import numpy as np

    r = random.Random(5)
    base = [f"t{i}" for i in range(200)]
    texts = []
    for _ in range(150):
        w = base[: r.randrange(20, 200)]
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "q"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    maps = np.frombuffer(b"".join(map(ngram_join.bitmap, sets)), np.uint64).reshape(len(sets), -1)
    tree = ngram_join.SignatureTree(maps, np.array([len(s) for s in sets]), np.arange(len(sets)))
    found = set()
    ngram_join.dual_traversal(tree, tree, lambda i, j: found.update(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)))
    want = {(a, b) for b in range(len(sets)) for a in range(b) if ngram_join.alike(sets[a], sets[b])}
    assert want and want <= found and len(found) < len(sets) * (len(sets) - 1) // 2


def test_ngram_join_finds_links_by_trees_alone(spark, monkeypatch):
    rows = [(i, cases.words(60, f"g{i // 2}-") + " end" * (i % 2)) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_components(d).collect())) == joined(rows)
    monkeypatch.setattr(ngram_join, "_blocks", lambda rows, hopeful: spark.createDataFrame([], "block long, a long, b long, sure boolean"))
    assert {r.component_id for r in ngram_join.ngram_components(d).collect()} == set(range(20))


def test_ngram_join_blocks_of_many_tiles_and_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 5)
    monkeypatch.setattr(ngram_join, "LEAST_HOT", 3)
    monkeypatch.setattr(ngram_join, "SURE", 0.7)  # so that pairs taken as sure prove wrong
    r, rows = random.Random(11), []
    base = cases.words(50).split()
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(50)] = f"x{r.randrange(20)}"
        rows.append((i, " ".join(w)))
    d = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, d.collect())) == joined(rows)


def test_ngram_join_texts_of_one_id(spark):
    a, b = cases.words(30, "a"), cases.words(30, "b")
    rows = [(5, a), (5, b), (3, a), (9, b + " x"), (None, cases.words(30, "n")), (None, cases.words(30, "m")), (8, cases.words(30, "m") + " x")]
    d = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in d if r.doc_id is not None) == [(3, 3), (5, 3), (5, 3), (8, 8), (9, 3)]
    assert sorted(str(r.component_id) for r in d if r.doc_id is None) == ["8", "None"]


def test_long_words_hash_alike_wherever_they_stand():
    word = "z" * (1 << 18)
    for w in (word, word + "z", word[1:]):
        assert shingle_set(f"a {w}").tolist() == shingle_set(f"a {w} ").tolist() == shingle_set(f"a\n{w}\n\n").tolist()


def test_components(spark):
    r, edges = random.Random(2), [(i, i + 1) for i in range(40)]
    edges += [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(500, x) for x in range(501, 540)] + [(7, 7)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: v for k, v in up.items() if sum(w == v for w in up.values()) > 1}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    base = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(base) for m in re.finditer(p, text or "") if ok(m[0]))


def test_pii_base(spark, docs):
    r = random.Random(4)
    made = ["".join(r.choice("ab1290.@-+ ()_%x\n5") for _ in range(r.randrange(120))) for _ in range(600)]
    made += ["4111 1111 1111 1111, x 1.2.3.4.5 y 256.1.1.1 a@b@c.d.e_f@g.h", "1 " * 5_000, "1." * 3_000, "a" * 5_000, "+1" + " " * 50_000]
    d = docs.select("doc_id", "text", "key").union(spark.createDataFrame([(100 + i, t, "k") for i, t in enumerate(made)], "doc_id long, text string, key string"))
    out = pii.find(d, pii.Trees()).select("text", "pii_base", "pii_spans", "redacted").collect()
    assert len(out) == d.count()
    for x in out:
        want = spans(x.text) if len(x.text or "") < 60_000 else []  # the longest texts hold nothing, and the plain patterns take a minute to see it
        assert [tuple(s) for s in x.pii_base] == want == [tuple(s) for s in x.pii_spans]
    assert pii.find(docs.limit(0), pii.Trees()).isEmpty()
    assert {tuple(r) for r in pii.find(docs, pii.Trees()).select("_base", "_spans", "_more", "row", "Kept").collect()} == {("mine",) * 5}
    one = next(x for x in out if x.text and "me@a.example.com" in x.text)
    assert one.redacted.endswith("mail [EMAIL] [PHONE]")


def test_pii_trees_add_secrets(spark):
    r, rows = random.Random(6), []
    for i in range(400):
        token = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((i, f"some words {r.randrange(10**9)} and token = \"{token}\" or u{i}@mail.example.com, call +1 (217) 555-{r.randrange(1000, 9999)}, id {r.randrange(10**11, 10**12)} end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    out = pii.find(docs, model).select("text", "pii_base", "pii_spans").collect()
    found = sum(any(s.kind == "secret" for s in x.pii_spans) for x in out)
    assert found == len(rows) and all({tuple(s) for s in x.pii_base} <= {tuple(s) for s in x.pii_spans} for x in out)
    assert pii.fit(docs.limit(0)).trees == []


def test_pii_trees_add_national_numbers_and_spelled_addresses(spark):
    r, rows = random.Random(9), []
    for i in range(600):
        number, cue = f"(0{r.randrange(10, 99)}) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}", "phone" if i % 3 else "reach us under"
        rows.append((i, f"order {r.randrange(1000, 9999)}-{r.randrange(10**5, 10**6)} of 2024-0{r.randrange(1, 9)}-1{i % 10}, {cue} {number} or jane{i} [at] example [dot] com, u{i}@mail.example.com"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for x in pii.find(docs, pii.fit(docs)).select("text", "redacted").collect():
        assert x.redacted == re.sub(r"u[0-9]+@[a-z.]+", "[EMAIL]", re.sub(r"jane.* com", "[EMAIL]", re.sub(r"\(0[0-9]+\) [0-9-]+", "[PHONE]", x.text)))


def test_pii_long_candidates_are_whole(spark):
    texts = [f"token: {'a1' * 5000} end", f"{'j' * 200} [at] {'e' * 100} [dot] com end"]
    out = pii.candidates(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {(s.kind, s.m) for x in out for s in x.spans} == {("secret", "a1" * 5000), ("email", texts[1].removesuffix(" end"))}


def counts(text):
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(words(line))
        seen.add(line)
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    repeat = len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)})
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, repeat, len(w) < 10 or 100 * repeat > 20 * len(w)


def test_quality_counts(spark, docs):
    r = random.Random(7)
    made = ["".join(r.choice(["a ", "b ", "c#\n", "d\n", "\n", " ", "a a a a a b "]) for _ in range(r.randrange(60))) for _ in range(300)]
    d = docs.select("doc_id", "text", "n_lines").union(spark.createDataFrame([(100 + i, t, 0) for i, t in enumerate(made)], "doc_id long, text string, n_lines long"))
    for x in quality.assess(d).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == counts(x.text)
        assert not (x.kept and x.base_failed)
    assert quality.assess(docs.limit(0)).isEmpty()
    own = quality.assess(docs)
    assert "Kept" not in own.columns and {tuple(r) for r in own.select("_q", "_lang", "row", "Toxicity").collect()} == {("mine",) * 4}


def test_quality_tokens_and_verdict(spark):
    good = " ".join("the quick brown fox jumps over a lazy dog while seven wizards mix strong potions near old castles".split() * 1)
    rows = [(1, good), (2, good.replace(" ", " \U00013000\U00013001\U00013002 ")), (3, " ".join("abcdefghijklmnop"[i % 16] * 40 for i in range(90)))]
    out = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept and out[1].script == "latin" and out[1].byte_share == 0 and 2 < out[1].chars_per_token < 7
    assert out[2].byte_share > 0.3 and not out[2].kept
    assert out[3].token_entropy < 8 and out[3].n_repeat_words == 90


def test_quality_bands_reject_what_base_rules_keep(spark):
    r = random.Random(5)
    known = "people water small house river under green market between summer window letter garden morning teacher history number country paper travel story music simple answer family friend building picture question village".split()
    text = lambda: " ".join(r.choice(known) for _ in range(r.randrange(70, 120)))
    junk = lambda: " ".join("".join(r.choice("abcdeiorstx") for _ in range(5)) + r.choice(("***", "%%%", "###")) for _ in range(90))
    rows = [(i, text(), "en") for i in range(400)] + [(1000 + i, junk(), "en") for i in range(20)] + [(2000 + i, "the same words stand here again and again with some more " + " ".join(known) * 3, None) for i in range(300)]
    out = {x.doc_id: x for x in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(out) == len(rows) and all(out[1000 + i].base_failed is False and not out[1000 + i].kept for i in range(20))
    assert sum(out[i].kept for i in range(400)) >= 396


def test_shared_folder_must_be_named_off_local_mode():
    from types import SimpleNamespace

    from granary.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs:///x"))) == "hdfs:///x"
