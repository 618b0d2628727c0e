"""PII trees learn from made spans; here they meet spans that were made otherwise."""

import random

import pytest
from pyspark.sql import functions as F

from granary.llm import pii
from granary.llm.common import table
from tests.llm import cases


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(table(spark, "/root/testdata/sf0.01", "documents"))


def test_thresholds_for_what_the_base_leaves(model):
    assert {"phone", "email", "secret"} <= set(model.thresholds)


def test_other_wording_than_was_made(spark, model):
    rnd = random.Random(11)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rnd.choice("bcdfghjklmnprstvwaeiou") for _ in range(n))
    mixed = lambda n: "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(n))
    good = {
        "phone": [lambda: ("Our desk: ", f"(0{digits(2)}) {digits(3)}-{digits(4)}"), lambda: ("please dial ", f"0{digits(3)} {digits(7)}"), lambda: ("voicemail ", f"0{digits(2)}/{digits(7)}"), lambda: ("or ", f"({digits(3)}) {digits(3)}-{digits(4)}")],
        "email": [lambda: ("ask ", f"{letters(5)} [at] {letters(8)} [dot] org"), lambda: ("ping ", f"{letters(4)}.{letters(6)} (at) {letters(7)}.eu"), lambda: ("by post or ", f"{letters(7)}[at]{letters(6)}.com")],
        "secret": [lambda: ("the token: ", mixed(22)), lambda: ('set api-key = "', mixed(30)), lambda: ("password=", mixed(18))],
    }
    bad = [lambda: ("dated ", f"20{digits(2)}-0{rnd.randint(1, 9)}-1{digits(1)}"), lambda: ("invoice ", f"{digits(4)} {digits(4)} {digits(4)}"), lambda: ("costs ", f"{digits(3)}.{digits(4)}"), lambda: ("we ", "meet (at) noon.Then"), lambda: ("password: ", "forgotten"), lambda: ("token = ", "insert_it_here")]
    rows, want = [], {}
    for i in range(300):
        kind = rnd.choice([*good, None, None])
        cue, span = rnd.choice(good[kind] if kind else bad)()
        head = "Some words of text stand here, and "
        rows.append((i, f"{head}{cue}{span} and others after."))
        want[i] = kind and f"{kind}:{len(head + cue)}:{len(head + cue + span)}"
    d = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model)
    got = {r.doc_id: r.spans for r in d.select("doc_id", pii.as_text(d.pii_spans).alias("spans")).collect()}
    positives = [i for i in want if want[i]]
    hit = sum(want[i] in got[i].split(",") for i in positives)
    false = sum(bool(got[i]) for i in want if not want[i])
    assert hit >= 0.9 * len(positives) and false <= 0.05 * (len(want) - len(positives))


def test_made_spans_stand_where_they_say(spark):
    d = pii.injected(cases.docs(spark).withColumnRenamed("doc_id", "id"))
    rows = d.collect()
    assert len(rows) == pii.EACH * 15 and {(r.kind, r.truth) for r in rows} == set(pii.MADE)
    assert all(r.text[r.start : r.end] == r.text[r.start : r.end].strip() and 0 <= r.start < r.end < len(r.text) for r in rows)
    assert sorted(map(str, pii.injected(cases.docs(spark).withColumnRenamed("doc_id", "id")).collect())) == sorted(map(str, rows))
    assert pii.injected(cases.docs(spark).withColumnRenamed("doc_id", "id").limit(0)).isEmpty()


def test_trees_learn_from_all_documents(spark, monkeypatch):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("u"), "id", F.lit("@mail.example.com or "), F.repeat(F.lit("555.123456 or "), 12)).alias("text"))
    learned, fit = [], pii.GBTClassifier.fit

    def spy(self, rows):
        learned.append(rows.agg(F.sum("n") if "n" in rows.columns else F.count("*")).first()[0])
        return fit(self, rows)

    monkeypatch.setattr(pii.GBTClassifier, "fit", spy)
    pii.fit(docs)
    made = pii.candidates(pii.injected(docs.withColumnRenamed("doc_id", "id"))).select("id", "start", "end", "spans").collect()
    assert len(made) == 1000 * pii.EACH
    assert sum(learned) == 1000 * 13 + sum(not s.base and s.start < r.end and r.start < s.end for r in made for s in r.spans)


def test_thresholds_count_all_candidates(spark):
    rnd, rows = random.Random(3), []
    for kind, right in (("phone", 0.4), ("email", 0.9), ("card", 1.1)):
        for _ in range(3000):
            p = rnd.random()
            rows.append((kind, p, float(rnd.random() < (p > right) + 0.01), rnd.randrange(1, 40)))
    got = pii.thresholds(spark.createDataFrame(rows, "kind string, p double, label double, n long"), 0.98, 10)
    assert set(got) == {"phone", "email"}

    def share(kind, p):
        taken = [r for r in rows if r[0] == kind and r[1] >= p]
        return sum(r[2] * r[3] for r in taken) / sum(r[3] for r in taken)

    for kind, t in got.items():
        lower = {int(r[1] * pii.STEPS) for r in rows if r[0] == kind and r[1] < t}
        assert share(kind, t) >= 0.98 and all(share(kind, step / pii.STEPS) < 0.98 for step in lower)
