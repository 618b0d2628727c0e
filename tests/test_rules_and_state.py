"""Rules held against data, scripts in order, nested JSON, spliced columns, state of streams."""

import json
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from granary.operators import constraints, schemadiff
from granary.operators.constraints import ConstraintError, Rule
from granary.sources import nested, scripts
from granary.streaming import statements as streaming


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def people(spark):
    data = [(1, "a", 10, 1), (2, "b", None, 2), (2, "c", -5, None), (None, "d", 3, 9), (4, None, 4, 1), (5, "a", 5, 1), (6, None, 7, 2)]
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    made = [Rule("pk", "PRIMARY KEY", ("id",)), Rule("name_set", "NOT NULL", ("name",)), Rule("name_once", "UNIQUE", ("name",)), Rule("positive", "CHECK", check="v > 0"), Rule("team", "FOREIGN KEY", ("team",), parent=parent, parent_columns=("id",))]
    return spark.createDataFrame(data, "id int, name string, v int, team int"), made


BROKEN = {(1, "a"): ["name_once"], (2, "b"): ["pk"], (2, "c"): ["pk", "positive"], (None, "d"): ["pk", "team"], (4, None): ["name_set"], (5, "a"): ["name_once"], (6, None): ["name_set"]}


def test_rules_that_rows_break(people, monkeypatch):
    df, rules = people
    for most in (constraints.BROADCAST_KEYS, 0):
        monkeypatch.setattr(constraints, "BROADCAST_KEYS", most)
        assert {(r.id, r.name): r.broken for r in constraints.marked(df, rules).collect()} == BROKEN
    assert {r.rule: r.n_rows for r in constraints.violations(df, rules).collect()} == {"pk": 3, "name_set": 2, "name_once": 2, "positive": 1, "team": 1}
    assert {r.n_rows for r in constraints.violations(df.limit(0), rules).collect()} == {0}
    for bad in ([rules[0], rules[0]], [Rule("x", "NOPE")]):
        with pytest.raises(ConstraintError):
            constraints.marked(df, bad)


def test_writing_counts_in_the_same_pass(spark, people, tmp_path):
    df, rules = people
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        read.add(1)
        return x

    rules = [r for r in rules if r.kind in ("NOT NULL", "CHECK")]
    # An opaque column that counts how often rows are read.
    assert constraints.write_checked(df.withColumn("v", counted.asNondeterministic()("v")), str(tmp_path / "a"), rules, most=3) == {"rows": 7, "name_set": 2, "positive": 1}
    assert read.value == 7
    assert constraints.read_checked(df, str(tmp_path / "a")).count() == 4
    assert rows(constraints.read_checked(df, str(tmp_path / "a"), quarantine=True).select("id", F.array_join("broken", ","))) == [(2, "positive"), (4, "name_set"), (6, "name_set")]
    with pytest.raises(ConstraintError, match="3 rows break rules: name_set 2, positive 1"):
        constraints.write_checked(df, str(tmp_path / "b"), rules, most=2)
    with pytest.raises(Exception, match="broken: "):
        constraints.write_checked(df, str(tmp_path / "c"), rules, most=0)


def test_scripts_in_order(spark, tmp_path):
    rnd = random.Random(1)
    data = [(rnd.choice(["hot", "hot", "hot", "b"]), rnd.randrange(10), i, f"S {i};\n-- two" if i % 5 == 0 else f"S {i};") for i in range(400)] + [("ddl", 1, 900, "only;"), ("data", 7, 901, "only;")]
    df = spark.createDataFrame(data, "schema string, priority int, pos long, statement string").repartition(7)
    scripts.write_scripts(df, str(tmp_path / "s"), data_from=5, parts=9)
    for schema in ("hot", "b", "ddl", "data"):
        files = sorted(pathlib.Path(tmp_path, "s", f"schema={schema}").glob("part-*"))
        own = sorted((p, i, t) for s, p, i, t in data if s == schema)
        both = any(p < 5 for p, _, _ in own) and any(p >= 5 for p, _, _ in own)
        want = [t for p, _, t in own if p < 5] + ([scripts.DIVIDER] if both else []) + [t for p, _, t in own if p >= 5]
        assert "".join(f.read_text() for f in files) == "".join(t + "\n" for t in want)
        assert schema != "hot" or len(files) > 4
    got = scripts.read_scripts(spark, str(tmp_path / "s")).filter("schema = 'b'").orderBy("file", "line").collect()
    assert [r.text for r in got] == [x for f in sorted(pathlib.Path(tmp_path, "s", "schema=b").glob("part-*")) for x in f.read_text().splitlines()]


def walk(value, path="$", depth=0, key=None):
    kind = "NULL" if value is None else {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL"}[type(value)]
    yield depth, path, key, kind
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from walk(v, f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", depth + 1, k if isinstance(value, dict) else None)


def test_nested_values_at_any_depth(spark):
    docs = ['{"type":"a","x":{"y":[1,{"z":"deep"}],"n":null}}', '{"type":"b","list":[]}', "[true,2.5]", "7", "null", "{broken", None, '{"type":"a","x":3}', "{}"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    good, bad = nested.parsed(df, "doc")
    assert [r.id for r in bad.collect()] == [5] and good.count() == 8
    found = nested.descend(good.select("id", "value"), "value")
    for i, doc in enumerate(docs):
        want = sorted(walk(json.loads(doc))) if doc and i != 5 else []
        got = [(r.depth, r.path, r.key, r.kind) for r in found.filter(F.col("id") == i).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), doc
    assert {r.scalar for r in found.filter("path like '%z'").collect()} == {"deep"}
    with pytest.raises(ValueError):
        nested.descend(good.select("id", "value"), "value", 2)
    tables = nested.shredded(good.select("id", "value"), "value", "$.type", {"a": {"z": "$.x.y[1].z string", "x": "$.x int"}, "b": {"first": "$.list[0] int"}})
    assert rows(tables["a"]) == [(0, "deep", None), (7, None, 3)] and rows(tables["b"]) == [(1, None)] and tables[""].count() == 5
    back = nested.written(good.select("id", "value"), "value").collect()
    assert all((None if r.value is None else json.loads(r.value)) == (json.loads(docs[r.id]) if docs[r.id] else None) for r in back)
    assert nested.descend(good.limit(0).select("id", "value"), "value").isEmpty()


def test_spliced_columns(spark):
    cols = spark.createDataFrame([("t", 1, "id", "INT"), ("t", 2, "AUD1", "OLD"), ("t", 3, "Its", "TS"), ("t", 4, "z", "INT"), ("u", 1, "b", "INT"), ("u", 7, "a", "INT")], "table_name string, position int, column_name string, sql_type string")
    d = schemadiff.splice_columns(cols, [(f"aud{i}", "T") for i in range(1, 8)], "ITS")
    got = {t: [r.column_name for r in sorted(d.filter(F.col("table_name") == t).collect(), key=lambda r: r.position)] for t in ("t_AT", "u_AT")}
    aud = [f"aud{i}" for i in range(1, 8)]
    assert got == {"t_AT": ["id", *aud, "Its", "z"], "u_AT": ["b", "a", *aud]}
    assert [r.position for r in d.filter("table_name = 't_AT'").orderBy("position").collect()] == list(range(1, 11))


def test_state_of_a_stream_stays_small_and_survives_a_restart(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rnd, want, sizes = random.Random(2), {}, []
        schema = "pos long, type string, table_name string"
        (tmp_path / "in").mkdir()
        stream = streaming.latest_by_state(streaming.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1))
        for start in range(2):  # the second run goes on where the first ended
            for b in range(4):
                batch = [(rnd.randrange(1000), rnd.choice(["Insert", "Update", "Set"]), rnd.choice("abcd")) for _ in range(15)]
                batch = [r for r in batch if r[0] not in {p for p, _ in want.values()}]
                for pos, kind, name in batch:
                    if kind != "Set" and (name not in want or want[name][0] < pos):
                        want[name] = pos, kind
                spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query = stream.writeStream.outputMode("update").foreachBatch(lambda d, n: d.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            sizes += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
        assert {(r.table_name, r.pos) for r in streaming.current(spark, f"{tmp_path}/out").collect()} == {(t, p) for t, (p, _) in want.items()}
        assert len(sizes) >= 8 and max(sizes) <= 4
    finally:
        spark.conf.set(key, old)
