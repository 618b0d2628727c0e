"""Digest trees find what a comparison of all rows finds, and read little for little differences."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import digesttree
from granary.operators.rowdiff import DiffError


def both_ways(old, new, key):
    """(key..., n_old, n_new), by EXCEPT ALL."""
    found = {}
    for side, d in enumerate((old.exceptAll(new), new.exceptAll(old))):
        for *k, n in d.groupBy(*key).count().collect():
            found.setdefault(tuple(k), [0, 0])[side] = n
    return sorted(((*k, *n) for k, n in found.items()), key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_same_as_comparing_all_rows(spark, kind):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(80)]), rnd.choice([None, "a", "b"]), rnd.choice([None, 1, 2])) for _ in range(600)]
    changed = [(k, v, 3) if rnd.random() < 0.05 else (k, v, w) for k, v, w in rows if rnd.random() > 0.02] + rows[:3]
    old, new = (spark.createDataFrame(r, "k long, v string, w int").withColumn("k", F.col("k").cast(kind)) for r in (rows, changed))
    for key in (["k"], ["k", "v"])[kind == "string" :]:
        got = digesttree.compare(old, new, key, ranges=9)
        assert sorted((tuple(r) for r in got.select(*key, "n_old", "n_new").collect()), key=str) == both_ways(old, new, key)
        assert {(r.side, r.n_old > 0, r.n_new > 0) for r in got.collect()} <= {("old", True, False), ("new", False, True), ("both", True, True)}
    assert digesttree.compare(old, old, ["k"], ranges=9).isEmpty()
    assert digesttree.compare(old, old.limit(0), ["k"]).agg(F.sum("n_old")).first()[0] == 600 == digesttree.compare(old.limit(0), old, ["k"]).agg(F.sum("n_new")).first()[0]
    with pytest.raises(DiffError, match="lacks w"):
        digesttree.compare(old, new.drop("w"), ["k"])


def test_nulls_and_swapped_columns_differ(spark):
    a = spark.createDataFrame([(1, None, "x")], "k int, v string, w string")
    assert digesttree.compare(a, a.select("k", F.col("w").alias("v"), F.col("v").alias("w")), ["k"]).collect()[0].side == "both"
    assert digesttree.compare(a, a.union(a).union(a), ["k"]).collect()[0].asDict() == {"k": 1, "side": "new", "n_old": 0, "n_new": 2}


def test_one_change_opens_one_leaf(spark, tmp_path):
    old = spark.range(200_000).select("id", (F.col("id") * 7 % 1000).alias("v"))
    old.repartitionByRange(16, "id").write.parquet(str(tmp_path / "old"))
    old = spark.read.parquet(str(tmp_path / "old"))
    new = old.withColumn("v", F.when(F.col("id") == 123_456, -1).otherwise(F.col("v")))
    at = digesttree.layout(old, ["id"], 100)
    kept = digesttree.digests(old, at)
    leaves = digesttree.differing(kept, digesttree.digests(new, at))
    assert leaves.count() == 1
    few = digesttree.opened(old, at, leaves)
    assert few.filter("id = 123456").count() == 1 and few.count() < 200_000 / 1000
    plan = few._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(id," in plan.split("PushedFilters:")[1].split("\n")[0]
    assert [r.id for r in digesttree.compare(old, new, ["id"], old_digests=kept, at=at).collect()] == [123_456]


def test_filters_cover_their_ranges(spark, monkeypatch):
    df = spark.range(-50, 400).select(F.when(F.col("id") % 9 != 0, F.col("id")).alias("k"), F.lit(1).alias("v"))
    at = digesttree.layout(df, ["k"], 20)
    for most in (64, 1):
        monkeypatch.setattr(digesttree, "MOST_FILTERS", most)
        for ranges in ([0], [0, 1], [3], [2, 3, 7], [len(at.bounds.values)], list(range(len(at.bounds.values) + 1))):
            inside = df.filter(at.range_of().isin(ranges))
            assert inside.exceptAll(df.filter(at.within(ranges))).isEmpty()
            if most > 1:
                assert inside.count() == df.filter(at.within(ranges)).count()
    assert df.select(at.range_of().alias("r")).distinct().count() == len(at.bounds.values) + 1
