"""Order keys, OFFSET over any order, ordered lists and joins by inequality against plain Spark and brute force."""

import bisect
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.ranges import Bounds, Order, bounds_of, order_key
from granary.operators import lists, paging, rangejoin

ROWS = [
    (None, None, None, None, None, None, None, None),
    (0, "", 0.0, Decimal("0.00"), dt.date(1970, 1, 1), dt.datetime(1970, 1, 1), False, b""),
    (-5, "a", -0.0, Decimal("-0.01"), dt.date(1969, 12, 31), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), True, b"\x00"),
    (7, "ab", 1e300, Decimal("123456.78"), dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 1, 2, 3, 4), True, b"\x00\x01"),
    (2**62, "b", -1e-300, Decimal("-123456.78"), dt.date(1, 1, 1), dt.datetime(1900, 1, 1), False, b"\xff"),
    (-(2**63), "é", float("inf"), Decimal("5.00"), dt.date(2024, 3, 1), dt.datetime(2024, 3, 1), None, b"a"),
    (2**63 - 1, "a\x00", float("nan"), None, None, None, False, None),
    (None, "a!", float("-inf"), Decimal("0.10"), dt.date(9999, 12, 31), dt.datetime(2100, 1, 1), True, b"ab"),
]
SCHEMA = "l long, s string, d double, n decimal(8,2), day date, at timestamp, b boolean, x binary"


@pytest.mark.parametrize("column", [c.split()[0] for c in SCHEMA.split(", ")])
def test_keys_sort_as_columns_do(spark, column):
    rnd = random.Random(column)
    df = spark.createDataFrame(ROWS + [tuple(rnd.choice(ROWS)[i] for i in range(8)) for _ in range(40)], SCHEMA).withColumn("i", F.monotonically_increasing_id())
    for text in (column, f"{column} DESC", f"{column} NULLS LAST", f"{column} desc nulls first"):
        by = [Order.parse(text), Order.parse("i DESC")]
        want = [r.i for r in df.orderBy(*(o.column() for o in by)).collect()]
        assert [r.i for r in df.orderBy(order_key(df, by)).collect()] == want


def test_orders_that_are_none():
    for text in ("a b", "a ASC LAST", "a NULLS", "a DESC NULLS MIDDLE"):
        with pytest.raises(ValueError):
            Order.parse(text)


def test_offset_over_any_order(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.choice(["x", "x", "x", "y", None]), rnd.choice([None, 1.5, 2.5]), i) for i in range(300)], "s string, d double, i int")
    order = ["s DESC NULLS FIRST", "d NULLS LAST", "i"]
    rows = [tuple(r) for r in df.orderBy(*(Order.parse(o).column() for o in order)).collect()]
    for n, limit in ((0, None), (1, None), (150, 20), (299, None), (300, None), (10, 0), (0, 1), (120, 1000)):
        assert [tuple(r) for r in paging.offset_rows(df, order, n, 11, limit).collect()] == rows[n:][:limit]
    tied = paging.offset_rows(df, ["s"], 100, 11)  # ties of the first column are split
    assert tied.count() == 200 and tied.exceptAll(df).isEmpty()


def test_offset_cuts_equal_rows(spark):
    data = [("a", 1)] * 5 + [("b", 2)] * 60 + [("c", None)] * 20 + [(None, 3)] * 15
    df = spark.createDataFrame(data, "s string, i int")
    order = ["s DESC", "i"]
    rows = [tuple(r) for r in df.orderBy(*(Order.parse(o).column() for o in order)).collect()]
    for n, limit in ((0, None), (10, None), (20, 30), (25, 10), (25, 60), (30, 55), (79, 2), (84, 100), (99, 1), (100, 5), (-3, None)):
        assert [tuple(r) for r in paging.offset_rows(df, order, n, 11, limit).collect()] == rows[max(n, 0) :][:limit]
    assert paging.offset_rows(df.limit(0), order, 3, 11, 2).isEmpty() and paging.offset_rows(df.limit(0), order, 0).isEmpty()


def test_offset_query_with_null_keys(spark, tmp_path):
    import duckdb
    from granary.plans.queries import ORACLES, QUERIES

    key = F.when(F.col("id") % 3 != 0, F.col("id"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") * (F.col("id") % 9)
    spark.range(4000).select(key.alias("o_orderkey"), F.when(F.col("id") % 100 == 0, None).otherwise("LOW").alias("o_orderpriority"), at.alias("o_orderdate")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in QUERIES["q_offset_mixed_order"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == con.execute(ORACLES["q_offset_mixed_order"]).fetchall()


def test_a_value_that_is_looked_up_is_computed_once(spark):
    names = spark.range(1000).select(F.concat(F.lit("n"), F.col("id")).alias("s"))
    for kind, values in (("s", None), ("d", (1.5, 2.5, 2.5, 9.0))):
        at = bounds_of(names, "s", 20) if values is None else Bounds(tuple(map(str, values)), T.DoubleType())
        x = F.translate("s", "0123456789", "9876543210") if values is None else F.col("s").substr(2, 9).cast("double") / 2
        d = names.select("s", at.upto(x).alias("upto"), at.below(x).alias("below"), x.alias("x"))
        if values is None:
            assert names.select(at.upto(x))._jdf.queryExecution().optimizedPlan().toString().split(" AS ")[0].count("translate(") == 1
            values = at.values
        for r in d.collect():
            assert (r.upto, r.below) == (bisect.bisect_right(values, r.x), bisect.bisect_left(values, r.x))
    none = names.limit(1).select(at.upto(F.lit(None).cast("double")), Bounds((), T.StringType()).upto(F.col("s")))
    assert tuple(none.first()) == (0, 0)


def test_lists_of_hot_groups_in_pieces_and_chunks(spark):
    rnd = random.Random(4)
    data = [(rnd.choice(["hot", "hot", "hot", "b", None]), i % 97, rnd.choice([f"v{i}", f"v{i}", None, "same"])) for i in range(800)] + [("nulls", 1, None)]
    df = spark.createDataFrame(data, "g string, o int, v string")
    want = {g: [v for _, v in sorted((-o, v) for h, o, v in data if h == g and v is not None)] for g in {r[0] for r in data}}
    for chars, ranges in ((10**6, 1), (10**6, 40), (50, 40)):
        got = {}
        for r in lists.ordered_lists(df, ["g"], ["o DESC"], "v", ";", chars, ranges).orderBy("chunk").collect():
            got.setdefault(r.g, []).append((r.chunk, r.n_values, r.text))
        for g, values in want.items():
            assert [c for c, _, _ in got[g]] == list(range(len(got[g]))) and sum(n for _, n, _ in got[g]) == len(values)
            assert ";".join(t for _, _, t in got[g] if t is not None) == ";".join(values)
        assert len(got["hot"]) == 1 if chars > 1000 else len(got["hot"]) > 5
        assert got["nulls"] == [(0, 0, None)]
    pieces = df.withColumn("r", bounds_of(df.withColumn("k", order_key(df, [Order.parse(x) for x in ("g", "o DESC", "v")])), "k", 40).upto(order_key(df, [Order.parse(x) for x in ("g", "o DESC", "v")])))
    assert pieces.groupBy("r").count().agg(F.max("count")).first()[0] < 800 / 8  # the hot group is no single task


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def sides(spark):
    rnd = random.Random(5)
    points = spark.createDataFrame([(i, rnd.choice([50, 50, 50, None, *range(100)])) for i in range(300)], "i int, p int")
    ends = [(rnd.choice([None, *range(-5, 105)]), rnd.choice([None, 0, 1, 3, 40, -2])) for _ in range(60)]
    return points, spark.createDataFrame([(j, a, None if a is None or w is None else a + w) for j, (a, w) in enumerate(ends)], "j int, a int, b int")


@pytest.mark.parametrize("closed", [(True, True), (False, True), (True, False), (False, False)])
def test_points_in_intervals(sides, closed):
    points, intervals = sides
    low = F.col("p") >= F.col("a") if closed[0] else F.col("p") > F.col("a")
    high = F.col("p") <= F.col("b") if closed[1] else F.col("p") < F.col("b")
    for how in ("inner", "left", "left_semi", "left_anti"):
        d = rangejoin.interval_join(points, intervals, "p", "a", "b", closed, how, bins=16)
        assert rows(d) == rows(points.join(intervals, low & high, how))
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_theta_and_overlap(sides):
    points, intervals = sides
    for op, on in (("<", F.col("p") < F.col("a")), ("<=", F.col("p") <= F.col("a")), (">", F.col("p") > F.col("a")), (">=", F.col("p") >= F.col("a"))):
        assert rows(rangejoin.theta_join(points, intervals, "p", op, "a", bins=16)) == rows(points.join(intervals, on))
    other = intervals.toDF("k", "c", "d").filter("k % 2 = 0")
    on = (F.col("a") <= F.col("d")) & (F.col("c") <= F.col("b")) & (F.col("a") <= F.col("b")) & (F.col("c") <= F.col("d"))
    got = rangejoin.overlap_join(intervals, other, ("a", "b"), ("c", "d"), bins=8).select("j", "a", "b", "k", "c", "d")
    assert rows(got) == rows(intervals.join(other, on))
    assert rangejoin.interval_join(points.limit(0), intervals, "p", "a", "b").isEmpty() and rangejoin.interval_join(points, intervals.limit(0), "p", "a", "b").isEmpty()
    with pytest.raises(ValueError):
        rangejoin.interval_join(points, points.select("i", "p"), "p", "p", "p")
    with pytest.raises(ValueError):
        rangejoin.theta_join(points, intervals, "p", "<>", "a")


def test_repeated_intervals_are_not_broadcast(spark):
    few = spark.range(1000).select("id", (F.col("id") % 97).alias("p"))
    d = rangejoin.theta_join(few, spark.range(50).select(F.col("id").alias("j"), (F.col("id") % 31).alias("a")), "p", "<", "a", "left")
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("closed", [(True, True), (False, True), (True, False), (False, False)])
def test_totals_are_those_of_the_pairs(spark, sides, closed):
    points, intervals = sides
    points = points.select(F.when(F.col("i") % 11 != 0, F.col("i") - 100).alias("i"), "p", F.when(F.col("i") % 4 != 0, F.col("i") % 4).alias("g"))
    intervals = intervals.select("a", "b", F.when(F.col("j") % 5 != 0, F.col("j") % 5).alias("h"))
    low = F.col("p") >= F.col("a") if closed[0] else F.col("p") > F.col("a")
    high = F.col("p") <= F.col("b") if closed[1] else F.col("p") < F.col("b")
    wanted = [F.count("*").alias("n"), F.count("i").alias("n_i"), F.sum("i").alias("sum_i")]
    for ends, on in ((("a", "b"), low & high), (("a", None), low), ((None, "b"), high)):
        pairs = points.join(intervals, on)
        got = rangejoin.interval_totals(points, intervals, "p", *ends, closed, ["i"], ["g"], ["h"], bins=16)
        assert rows(got) == rows(pairs.groupBy("h", "g").agg(*wanted))
    kept = points.join(intervals, low, "right").groupBy("a", "h").agg(F.count("p").alias("n"), *wanted[1:])
    assert rows(rangejoin.interval_totals(points, intervals, "p", "a", None, closed, ["i"], of=["a", "h"], how="left", bins=16)) == rows(kept)


def test_totals_of_odd_tables(spark, sides):
    points, intervals = sides
    for p, i in ((points.limit(0), intervals), (points, intervals.limit(0)), (points.filter("p IS NULL"), intervals)):
        assert rangejoin.interval_totals(p, i, "p", "a", "b", of=["j"], by=["i"]).isEmpty()
        assert [tuple(r) for r in rangejoin.interval_totals(p, i, "p", "a", None, sums=["i"], of=["j"], how="left").drop("j").distinct().collect()] in ([], [(0, 0, None)])
    long = 2**63 - 1
    large = spark.createDataFrame([(1.0, long), (2.0, long), (float("nan"), -long), (-0.0, 5)], "p double, k long")
    ends = spark.createDataFrame([(1, 0.5, 1.5), (2, 1.5, 3.0), (3, 2.5, float("nan")), (4, 0.0, 0.0)], "j int, a double, b double")
    got = rangejoin.interval_totals(large, ends, "p", "a", "b", sums=["k"], of=["j"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, long), (2, 1, 1, long), (3, 1, 1, -long), (4, 1, 1, 5)]
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 2, 3)], "day date")
    spans = spark.createDataFrame([(dt.date(2024, 1, 1), dt.datetime(2024, 1, 2, 12))], "a date, b timestamp")
    assert [r.n for r in rangejoin.interval_totals(days, spans, "day", "a", "b", (False, True)).collect()] == [2]
    for wrong in ({"how": "left", "by": ["p"]}, {"sums": ["p"]}, {"how": "left_anti"}):
        with pytest.raises(ValueError):
            rangejoin.interval_totals(large, ends, "p", "a", "b", **wrong)
    with pytest.raises(ValueError):
        rangejoin.interval_totals(large, ends, "p", None, None)


def most_rows(df):
    """The largest number of rows that a step of df's plan gives."""
    df.collect()
    most, steps = 0, [df._jdf.queryExecution().executedPlan()]
    while steps:
        step = steps.pop()
        kind = step.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            steps.append(step.executedPlan() if kind == "AdaptiveSparkPlanExec" else step.plan())
            continue
        made = step.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        steps += [step.children().apply(i) for i in range(step.children().size())]
    return most


def test_counting_queries_make_no_pairs(spark, sf_dir):
    from granary.plans.queries import QUERIES

    rows_read = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in ("q_theta_join",):
        assert 0 < most_rows(QUERIES[name](spark, sf_dir)) <= rows_read


def test_a_band_of_one_day_makes_no_pairs(spark, tmp_path):
    from granary.plans.queries import QUERIES

    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    spark.range(300).select(F.lit("HIGH").alias("o_orderpriority"), day.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(700).select(F.col("id").alias("l_orderkey"), F.lit("F").alias("l_linestatus"), (day + F.expr("INTERVAL 1 HOUR") * (F.col("id") % 24 + 1)).alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    d = QUERIES["q_band_join"](spark, str(tmp_path))
    assert [tuple(r) for r in d.collect()] == [("HIGH", "F", 300 * 700, 300 * sum(range(700)))]
    assert most_rows(d) <= 700


def test_times_without_zone_have_quantiles(spark):
    times = spark.range(1000).select((F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL 1 SECOND") * F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id"))).alias("p"))
    at = bounds_of(times, "p", 32, repeats=True)
    assert len(at.values) == 31 and at.values.count("2024-01-01 00:00:07") > 10


def test_hot_values_are_spread_over_bins(spark):
    points = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("p"))
    at = bounds_of(points, "p", 32, repeats=True)
    span = points.filter("p = 7").select((at.upto(F.col("p")) - at.below(F.col("p")) + 1).alias("n")).first().n
    assert span > 10 and len(at.values) == 31
