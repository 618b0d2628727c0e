"""The registered queries on the smallest tables, against SQL or brute force; learned results by held-out labels."""

import hashlib
import zlib

import duckdb
import pytest

from granary.llm import decontamination, html_text, queries
from granary.llm.common import table
from granary.llm.shingles import PLAIN, word_hashes
from tests.llm.test_exact import counts, spans
from tests.test_queries import TABLES, rows


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    d, rel = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    assert rows(d.columns, [tuple(r) for r in d.collect()]) == rows(rel.columns, rel.fetchall())


def test_op1_and_op8(spark, sf_dir, docs):
    for query, parts, out in ((queries.op1_toxicity, (5, 0), 0.5), (queries.op8_language_id, (4, 2), None)):
        d = query(spark, sf_dir).collect()
        assert sorted(r.doc_id for r in d) == sorted(docs)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts[0] == parts[1]) and 0 <= r.score <= 1 for r in d)
        if out:
            assert all(r.predicted == (r.score >= out) for r in d)
        else:
            assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or "")) for r in d)


def test_op3(spark, sf_dir, docs):
    items = {r.item_id: word_hashes(r.text, PLAIN) for r in table(spark, sf_dir, "benchmark").collect()}
    want = set()
    for i, r in docs.items():
        w = word_hashes(r.text, PLAIN)
        for k, b in items.items():
            e = decontamination.allowed(len(b), 0.2)
            if len(b) and len(set(b.tolist()) & set(w.tolist())) >= len(set(b.tolist())) - e and decontamination.best_match(b, w)[0] <= e:
                want.add((i, k))
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, sf_dir).collect()}
    assert want and got <= want and len(got) >= 0.95 * len(want)


def test_op5(spark, sf_dir, docs):
    d = queries.op5_quality_fertility(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in d) == sorted(docs)
    for r in d:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(docs[r.doc_id].text)
        assert not (r.kept and r.base_failed)


def test_op6(spark, sf_dir, docs):
    d = queries.op6_pii(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in d) == sorted(docs)
    for r in d:
        base = spans(docs[r.doc_id].text)
        text = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in ("email", "ip", "card", "phone"))


def test_op7(spark, sf_dir):
    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    d = queries.op7_html_main_text(spark, sf_dir).collect()
    assert sorted(r.page_id for r in d) == sorted(pages)
    assert all(r.text == html_text.main_text(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in d)
