"""Language ID and toxicity by accuracy on held-out rows; decontamination, HTML and WARC by what was planted and by round trips."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import decontamination, html_text, language_id, queries, toxicity, warc
from granary.llm.common import scratch, table
from tests.llm import cases

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return cases.docs(spark).cache()


def test_language_id(spark):
    d = queries.op8_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(d) > 100 and sum(r.lang == r.lang_pred for r in d) / len(d) > 0.97 and sum(r.rejected for r in d) / len(d) < 0.01
    assert all(0 <= r.score <= 1 for r in d)


def test_language_id_awkward(docs):
    out = language_id.identify(docs, language_id.fit(docs)).select("text", "lang_pred", "lang_score", "lang_rejected").collect()
    assert len(out) == docs.count()
    for r in out:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.lang_score == 0 and r.lang_rejected))
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).select("lang_pred").collect()} == {"und"}


def test_language_id_rejects_other_scripts(spark):
    d = spark.createDataFrame([(i, "this is a plain english sentence about nothing much " * 3, "en") for i in range(60)], "doc_id long, text string, lang string")
    far = spark.createDataFrame([(1, "такая фраза о погоде " * 8)], "doc_id long, text string")
    model = language_id.fit(d)
    assert language_id.identify(far, model).first().lang_rejected and not language_id.identify(d, model).first().lang_rejected


def test_language_id_rejects_a_language_not_learnt(spark):
    docs = table(spark, SF, "documents").filter("text is not null")
    for lang in ("en", "fr"):
        model = language_id.fit(docs.filter(F.col("lang") != lang))
        d = language_id.identify(docs.filter("length(text) > 300"), model).groupBy((F.col("lang") == lang).alias("foreign")).agg(F.avg(F.col("lang_rejected").cast("int")).alias("share")).collect()
        share = {r.foreign: r.share for r in d}
        assert share[True] > 0.8 and share[False] < 0.03


def test_language_id_rejects_by_language_at_all_lengths(spark):
    docs = table(spark, SF, "documents").filter("text is not null and lang is not null")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    counts = dict.fromkeys(((n, f) for n in (50, 200, 1000) for f in (True, False)), (0, 0))
    for lang in ("de", "en", "es", "fr"):
        model = language_id.fit(docs.filter(~held_out & (F.col("lang") != lang)))
        for n in (50, 200, 1000):
            cut = docs.filter(held_out & (F.length("text") >= n)).withColumn("text", F.substring("text", 1, n))
            for r in language_id.identify(cut, model).groupBy((F.col("lang") == lang).alias("f")).agg(F.sum(F.col("lang_rejected").cast("int")).alias("no"), F.count("*").alias("n")).collect():
                a, b = counts[n, r.f]
                counts[n, r.f] = (a + r.no, b + r.n)
    assert all(no / of >= 0.8 if foreign else no / of <= 0.01 for (_, foreign), (no, of) in counts.items()), counts
    model = language_id.fit(docs.filter(~held_out))
    for text in ("Il gatto dorme sul divano mentre la pioggia cade lenta sulla citta.", "Kissa nukkuu sohvalla kun sade putoaa hitaasti kaupungin kaduille."):
        assert model.predict([text, text * 5]) and all(rejected for *_, rejected in model.predict([text, text * 5]))


def test_language_id_takes_no_more_languages_than_it_can_hold(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    d = spark.createDataFrame([(1, "eins zwei", "de"), (2, "one two", "en")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.fit(d)
    model = language_id.fit(d.filter("lang = 'en'"))
    assert (model.langs, model.predict(["one two"])[0][0]) == (["en"], "en")


def test_toxicity(spark):
    d = queries.op1_toxicity(spark, SF).join(table(spark, SF, "documents").select("doc_id", "text"), "doc_id").collect()
    bad = re.compile(r"\b(?:trash|pathetic|idiot|worthless|disgusting|stupid|clown|loser|scum|moron)\b", re.I)  # what the made-up documents are labelled for
    held = [r for r in d if r.held_out]
    assert sum(r.predicted for r in held if bad.search(r.text)) >= 0.7 * sum(bool(bad.search(r.text)) for r in held)
    assert sum(r.predicted for r in held if not bad.search(r.text)) <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in d)


def test_toxicity_of_long_calm_texts(spark):
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    for sentence in ("the calm river runs to the sea. ", "On the inand of the erth. ", " . "):
        scores = [model.sentences(sentence * n)[0] for n in (1, 100, 1000, 5000)]
        assert max(scores) < 0.5 and scores[3] <= scores[0] + 0.01
    assert model.sentences("A. B. ")[1] == 2
    hit = next(w for w, x in sorted(model.weights.items(), key=lambda i: -i[1]))
    assert model.sentences("the calm river. " * 500 + hit + ".")[0] >= model.sentences("the calm river. " * 500)[0]


def test_toxicity_locates_sentences(spark, docs):
    r, rows, labels = random.Random(1), [], []
    plain = [f"word{i}" for i in range(40)]
    for i in range(300):
        s = [" ".join(r.choices(plain, k=8)) for _ in range(5)]
        if i % 4 == 0:
            s[r.randrange(5)] += " vile"
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for x in toxicity.score(d, model).collect():
        assert (x.toxicity >= 0.5) == ("vile" in x.text) and all("vile" in x.text[s.start : s.end] for s in x.toxic_spans)
    out = toxicity.score(docs, model).select("text", "toxicity", "n_sentences").collect()
    assert all(r.toxicity == 0 and r.n_sentences == 0 for r in out if not r.text) and len(out) == docs.count()
    none = toxicity.fit(d, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert none.weights == {} and toxicity.score(docs.limit(0), none).isEmpty()


def edits(a, b):
    """The least edit distance of a and any run of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    r = random.Random(8)
    items = [(i, " ".join(f"b{r.randrange(400)}" for _ in range(r.choice((6, 9, 14, 25, 40, 60))))) for i in range(30)]
    rows = []
    for d in range(240):
        w = [f"{r.choice('bc')}{r.randrange(400)}" for _ in range(r.randrange(20, 90))]
        if d % 2:
            x = items[d % 30][1].split()
            for _ in range(r.randrange(decontamination.allowed(len(x), 0.2) + 1)):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice(([], ["new"], [x[k], "more"]))
            at = r.randrange(len(w))
            w[at:at] = x
        rows.append((d, " ".join(w)))
    want = {(d, i) for d, t in rows for i, b in items if edits(b.split(), t.split()) <= decontamination.allowed(len(b.split()), 0.2)}
    found = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id) for x in found}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 100
    exact = {(d, i) for d, t in rows for i, b in items if f" {b} " in f" {t} "}
    assert exact <= got and all(x.distance == 0 for x in found if (x.doc_id, x.item_id) in exact)


def edited_copies(n, k, copies, seed):
    """Items of n random words, and for each copy a text with one of them, as many edits as allowed, and other words around."""
    r = random.Random(seed)
    items = [(i, " ".join(f"b{r.randrange(10**6)}" for _ in range(n))) for i in range(k)]
    texts = []
    for c in range(copies):
        x = items[c % k][1].split()
        for _ in range(decontamination.allowed(n, 0.2)):
            at, new = r.randrange(len(x)), f"n{r.randrange(10**9)}"
            x[at : at + 1] = r.choice(([], [new], [new, x[at]]))
        texts.append(" ".join([f"p{r.randrange(10**6)}" for _ in range(20)] + x + [f"p{r.randrange(10**6)}" for _ in range(20)]))
    return items, pa.array(texts)


@pytest.mark.parametrize("n", [400, 800, 1500])
def test_decontamination_finds_long_items(n):
    items, texts = edited_copies(n, 10, 20, n)
    found = decontamination.search(texts, decontamination.build_index(items, 0.2, 0.95))
    assert {(c, c % 10) for c in range(20)} == {(row, i) for row, i, *_ in found}
    assert all(distance <= n // 5 for *_, distance in found)


@pytest.mark.parametrize(("n", "k"), [(10, 1), (15, 4), (20, 1), (30, 3), (50, 1), (80, 1), (80, 40), (200, 3)])
def test_decontamination_recall_by_size(n, k):
    share = []
    for seed in range(3):
        items, texts = edited_copies(n, k, 200, seed)
        found = {(row, i) for row, i, *_ in decontamination.search(texts, decontamination.build_index(items, 0.2, 0.95))}
        share.append(sum((c, c % k) in found for c in range(200)) / 200)
    assert sum(share) / 3 >= 0.94 and min(share) >= 0.91  # 600 copies have a standard error of 0.009, 200 of 0.015


def test_decontamination_tells_where_matches_begin():
    item = cases.words(20, "i").split()
    for n, changed in ((20, item), (22, item[:5] + ["x", "y"] + item[5:]), (18, item[:5] + item[7:]), (20, item[:9] + ["x"] + item[10:])):
        index = decontamination.build_index([(7, " ".join(item))], 0.2, 0.95)
        text = " ".join(["p", "q", "r", *changed, "s", "t"])
        assert [x[1:4] for x in decontamination.search(pa.array([text]), index)] == [(7, 3, 3 + n)]
    long = cases.words(500, "l").split()  # no walks for these
    index = decontamination.build_index([(7, " ".join(long))], 0.2, 0.95)
    assert [x[1:4] for x in decontamination.search(pa.array([" ".join(["p", "q", *long[:50], "x", "y", *long[50:], "s"])]), index)] == [(7, 2, 504)]


def test_decontamination_blocks_and_awkward_rows(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, cases.words(20)), (2, None), (3, ""), (None, "x y z"), (4, cases.words(20, "long")), (5, "ONE, two!")], "item_id long, text string")
    want = {(1, 1), (3, 1), (4, 1), (8, 5), (9, 5), (10, 4)}
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()} == want
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 60)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()} == want
    assert decontamination.leaks(docs.limit(0), items).isEmpty() and decontamination.leaks(docs, items.limit(0)).isEmpty()


def test_embedding_finds_few_edits_more_often():
    import numpy as np

    r = np.random.default_rng(1)
    a = r.integers(1, 2**62, (400, 25)).astype(np.uint64)
    a[:, -1] = 0
    near, far = a.copy(), r.integers(1, 2**62, a.shape).astype(np.uint64)
    near[:, 3] = 1
    met = [decontamination.Walk(24, n).keys(a) == decontamination.Walk(24, n).keys(near) for n in range(12)]
    assert np.any(met, axis=0).mean() > 0.95 and not any((decontamination.Walk(24, n).keys(a) == decontamination.Walk(24, n).keys(far)).any() for n in range(12))
    texts = pa.array(["a b c d e f g h", None, ""])
    index = decontamination.build_index([(7, "b c d e f")], 0.2, 0.95)
    assert decontamination.search(texts, index) == [(0, 7, 1, 6, 0)]


def test_main_text_of_made_pages(spark):
    pages = table(spark, SF, "pages")
    for r in html_text.extract(pages).collect():
        html = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", __import__("html").unescape(re.sub("<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)[^>]*>", html)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href=/>Home</a></header>
<div id="nav"><a href=1>One</a> <a href=2>Two</a></div><div class="wrap"><div class="content"><h2>Head &amp; line</h2>
<p>First   paragraph, with <a href=x>a link</a> and <b>bold</b> words; it goes on for a while.</p><p>Second paragraph, which is also long enough to count.</p>
<script>var a = "<p>no</p>"</script><ul><li>Point one, said at some length here.</li><li>Point two, said at some length too.</li></ul></div>
<aside>Related things, here is a long text that is no article, at all.</aside><div class="comments"><p>Great article, I liked it very much, thanks!</p></div></div>
<form><p>Subscribe now, it is free.</p></form><footer>Legal notes, and more of them, at length.</footer></body></html>"""


def test_main_text_without_article_element():
    assert html_text.main_text(PAGE).split("\n") == [
        "Head & line", "First paragraph, with a link and bold words; it goes on for a while.", "Second paragraph, which is also long enough to count.", "Point one, said at some length here.", "Point two, said at some length too.",
    ]
    for odd in (None, "", "<", "<p", "plain text, without any tag at all.", "<div" * 3000, "<!-- x", "<script>never closed", '<a href="' * 2000):
        html_text.main_text(odd)
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"


def test_main_text_without_article_class_and_id(spark):
    kept = all_ = other = changed = 0
    for r in table(spark, SF, "pages").limit(100).collect():
        whole = html_text.main_text(r.html).split("\n")
        bare = re.sub(r'\s(?:class|id)="[^"]*"', "", re.sub("</?article>", "", r.html))
        found = html_text.main_text(bare)
        kept += sum(len(x) for x in whole if x in found.split("\n"))
        all_ += sum(map(len, whole))
        other += sum(len(x) for x in found.split("\n") if x not in whole)
        changed += html_text.main_text(bare, threshold=1e-12) != found
        assert html_text.main_text(r.html, threshold=1e9) == ""
        for before, after in ((r"<body>(.*)</body>", r"<body><form>\1</form></body>"), (r"<article>(.*)</article>", r'<div class="story-share-free">\1</div>')):
            assert html_text.main_text(re.sub(before, after, r.html, flags=re.S)).split("\n") == whole
    assert kept >= 0.95 * all_ and other <= 0.02 * all_ and changed >= 50


def test_main_text_of_quoted_signs_and_tables():
    assert html_text.main_text('<p>My <a title="1<2">friend</a> says that 3 &gt; 2, at length.</p>') == "My friend says that 3 > 2, at length."
    assert html_text.main_text("<p title=it's>One, with some words.</p><p>Two isn't the same, is it?</p>") == "One, with some words.\nTwo isn't the same, is it?"
    page = "<div><h2>Head</h2><p>" + "A paragraph, of some length. " * 9 + "</p><table><tr><td>1</td><td>2</td></tr></table><p>" + "Another one, as long as that. " * 9 + "</p></div>"
    assert html_text.main_text(page).split("\n")[0] == "Head" and html_text.main_text(page).split("\n")[2:4] == ["1", "2"]


def test_main_text_keeps_the_head_of_an_article():
    page = '<body><div class="{}"><h1>Head of it</h1></div><div><p>' + "A paragraph, of some length. " * 9 + "</p></div></body>"
    assert html_text.main_text(page.format("post-header")).startswith("Head of it\n") and not html_text.main_text(page.format("site-header")).startswith("Head")


def test_html_awkward(spark):
    pages = cases.pages(spark)
    out = html_text.extract(pages)
    assert out.count() == pages.count() and {r.n_chars for r in out.filter("html is null").collect()} == {0}
    assert html_text.extract(pages.limit(0)).isEmpty()


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = cases.pages(spark)
    folder = scratch(spark, "test-archives")
    warc.archive(pages, folder)
    found = warc.find_captures(warc.keys_of(pages), f"{folder}/index").collect()
    rows = pages.collect()
    assert sorted((r.page_id for r in found), key=str) == sorted((r.page_id for r in rows), key=str)
    html = {r.page_id: r.html or "" for r in rows}
    for r in found:
        same = [p for p, h in html.items() if h == html[r.page_id] and p is not None]
        again = len(html[r.page_id]) >= 1000 and r.page_id != max(same)
        assert (r.record_type, r.refers_to, r.payload_bytes) == (("revisit", max(same)) if again else ("response", None)) + (len(html[r.page_id].encode()),)
        headers, block = warc.read_record(spark, r.file, r.offset, r.length)
        assert headers["warc-type"] == r.record_type and block.endswith(b"" if again else html[r.page_id].encode())
    some = spark.createDataFrame([("com,example,a,www)/x?y",), ("nothing",), (None,)], "key string")
    want = {1, 2, 3}
    assert {r.page_id for r in warc.find_captures(some, f"{folder}/index").collect()} == want
    plan = warc.find_captures(some, f"{folder}/index")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard", plan) and re.search(r"PushedFilters: \[[^\]]*block", plan)
    records = warc.fetch_records(warc.find_captures(warc.keys_of(pages), f"{folder}/index")).collect()
    assert len(records) == len(rows)
    for r in records:
        assert r.headers["warc-type"] == r.record_type and r.payload == (None if r.record_type == "revisit" else html[r.page_id].encode())
    monkeypatch.setattr(warc, "MOST_SPANS", 1)
    assert {r.page_id for r in warc.find_captures(some, f"{folder}/index").collect()} == want
    monkeypatch.setattr(warc, "BROADCAST_BLOCKS", 0)
    assert {r.page_id for r in warc.find_captures(some, f"{folder}/index").collect()} == want


def test_warc_empty(spark):
    folder = scratch(spark, "test-archives")
    warc.archive(cases.pages(spark).limit(0), folder)
    assert warc.find_captures(spark.createDataFrame([("k",)], "key string"), f"{folder}/index").isEmpty()


def test_surt():
    assert [warc.surt(u) for u in ("https://user@WWW.Example.com:80/a?b#c", "mailto:x", "", None)] == ["com:80,example,www)/a?b#c", "mailto:x", "", ""]
