"""The pipeline, stage by stage, each judged on its own input."""

import corpus_pipeline
from granary.llm import decontamination, mixing
from granary.llm.common import stored, table
from tests.llm import cases
from tests.llm.test_exact import dedup, joined
from tests.llm.test_learned import SF


def test_stages(spark):
    docs = table(spark, SF, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), f"test-{name}")
        steps[name] = docs, out
        assert name == "mixing" or out.columns == docs.columns
        docs = out
    pairs = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    before, after = steps["language_id"]
    assert before.count() - after.count() <= 0.01 * before.count()
    before, after = steps["line_dedup"]
    assert sorted(((i, t or "") for i, t in pairs(after)), key=str) == [x[:2] for x in dedup(pairs(before))]
    assert after.filter("n_chars <> char_length(text)").isEmpty()
    before, after = steps["ngram_join"]
    assert sorted(i for i, _ in pairs(after)) == sorted(i for i, _, top in joined(pairs(before)) if i == top)
    before, after = steps["decontamination"]
    gone = {r.doc_id for r in decontamination.leaks(before, table(spark, SF, "benchmark")).collect()}
    assert {i for i, _ in pairs(before)} - {i for i, _ in pairs(after)} == gone and gone
    before, after = steps["mixing"]
    assert sorted(map(str, after.collect())) == sorted(map(str, mixing.mix(before).filter("taken > 0").collect()))


def test_awkward_rows(spark):
    docs = cases.docs(spark)
    for start in (docs, docs.limit(0)):
        d = start
        for name, stage in corpus_pipeline.STAGES:
            d = stored(stage(spark, d, "/root/testdata/sf0.001"), f"test-{name}")
        assert d.isEmpty() == (start is not docs)
