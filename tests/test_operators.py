"""Operators on small tables whose results are known."""

import pytest
from pyspark.sql import functions as F

from granary.functions import sql as fn
from granary.operators import dml, joins, paging, rowdiff, schemadiff, statements
from granary.sources import sinks, tables
from granary.streaming import statements as streaming

USERS = "id int, name string, email string"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rowdiff_cases(spark):
    old = spark.createDataFrame([(1, "Alice", "alice@old"), (2, "Bob", "bob@x"), (3, "Carl", None), (5, "Eve", None), (6, "Fay", None)], USERS)
    new = spark.createDataFrame([(1, "Alice", "alice@updated"), (2, "Bob", "bob@x"), (4, "Diana", "diana@x"), (5, "Eve", None), (6, "Fay", "fay@x")], USERS)
    d = rowdiff.diff(old, new, ["id"])
    assert got(d.select("op", "id", F.array_join("changed", ","))) == [("DELETE", 3, None), ("INSERT", 4, None), ("UPDATE", 1, "email"), ("UPDATE", 6, "email")]
    assert got(rowdiff.diff(old, new, ["id"], deletes=False).select("op").distinct()) == [("INSERT",), ("UPDATE",)]
    assert got(rowdiff.apply_changes(old, d, ["id"])) == got(new)
    assert rowdiff.diff(new, new, ["id"]).isEmpty()


def test_rowdiff_null_keys_repeats_and_missing_columns(spark):
    old = spark.createDataFrame([(None, 1, 0), (7, 1, 0), (7, 2, 1)], "k int, v int, at int")
    new = spark.createDataFrame([(None, 1), (7, 2)], "k int, v int")
    assert rowdiff.diff(old, new, ["k"], last_by=["at"]).isEmpty()
    wider = new.withColumn("extra", F.lit(None).cast("string"))
    assert got(rowdiff.diff(new, wider, ["k"]).select("op", F.array_join("changed", ","))) == [("UPDATE", "extra"), ("UPDATE", "extra")]
    assert got(rowdiff.duplicates(old, ["k"])) == [(7, 2)]


def test_keys(spark):
    df = spark.createDataFrame([(1, 2)], "Id int, v int")
    assert rowdiff.key_of("t", df, ["ID"]) == ["Id"] and rowdiff.key_of("t", df, None, {"T": ["id"]}) == ["Id"]
    with pytest.raises(rowdiff.DiffError, match="t: no key.*"):
        rowdiff.key_of("t", df, None)
    with pytest.raises(rowdiff.DiffError, match="a: .*; b: .*"):
        rowdiff.diff_tables({"a": df, "b": df}, {"a": df, "b": df}, {})


def test_tables_without_key_fall_back_to_inserts(spark):
    df = spark.createDataFrame([(1, 2)], "id int, v int")
    changed = df.withColumn("v", F.lit(3))
    d = rowdiff.diff_tables({"a": df, "b": df}, {"a": changed, "b": changed}, {"a": ["id"]}, fall_back=True)
    assert got(d.select("table_name", "op", "row_key")) == [("a", "UPDATE", '{"id":1}'), ("b", "INSERT", '{"id":1,"v":3}')]


def test_apply_changes(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a", 7), (None, "z", 8)], "k int, v string, w int")
    assert got(rowdiff.apply_changes(old, rowdiff.diff(old, new, ["k"]), ["k"])) == got(new)
    only = old.select("k")
    assert got(rowdiff.apply_changes(only, rowdiff.diff(only, only.filter("k = 1"), ["k"]), ["k"])) == [(1,)]


def test_offset(spark):
    d = spark.createDataFrame([(None, 0), *((i // 3, i) for i in range(100))], "a int, b int")
    rows = [tuple(r) for r in d.orderBy("a", "b").collect()]
    for n in (0, 1, 50, 100, 101, 500):
        assert [tuple(r) for r in paging.offset_rows(d, ["a", "b"], n, 7).collect()] == rows[n:]
    assert paging.offset_rows(d.limit(0), ["a"], 3).isEmpty()


def test_primary_keys_by_name(spark):
    of = lambda *rows: spark.createDataFrame([("t", "PRIMARY KEY", *r) for r in rows], "table_name string, kind string, name string, definition string")
    assert schemadiff.diff_constraints(of(("SYS_C1", "a")), of((None, "a"))).isEmpty()
    assert got(schemadiff.diff_constraints(of(("pk", "a")), of(("other", "a"))).select("op")) == [("ADD",), ("DROP",)]


def test_fan_out_and_dialects(spark, tmp_path):
    sinks.write_by_key(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, t string"), str(tmp_path / "out"), "t")
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.name.startswith("t=")) == ["t=a", "t=b"] and spark.read.json(str(tmp_path / "out" / "t=a")).count() == 2
    assert [tables.dialect_of(x) for x in ("jdbc:oracle:thin:@h", "JDBC:postgresql://h/d", "jdbc:x:")] == ["oracle", "postgres", "ansi"]


def test_dml(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert got(dml.delete(t, F.col("v") == "a")) == [(2, None)]
    assert got(dml.update(t, F.col("k") == 2, v=F.lit("z"))) == [(1, "a"), (2, "z")]
    with pytest.raises(ValueError):
        dml.insert(t, t, ["k"])
    assert got(dml.insert_or_replace(t, spark.createDataFrame([(2, "b"), (3, "c")], t.schema), ["k"])) == [(1, "a"), (2, "b"), (3, "c")]


def test_not_in(spark):
    t = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    of = lambda *x: spark.createDataFrame([(v,) for v in x], "b int")
    assert got(joins.not_in_subquery(t, "a", of(1))) == [(2,)]
    assert got(joins.not_in_subquery(t, "a", of(1, None))) == []
    assert len(got(joins.not_in_subquery(t, "a", of()))) == 3


def test_statement_stream(spark, tmp_path):
    rows = [(0, "Set", None), (1, "CreateTable", "a"), (2, "Insert", "a"), (3, "DropTable", "a"), (4, "CreateTable", "a"), (5, "Insert", "a"), (6, "Prompt", None), (7, "DropTable", "b"), (8, "Select", None)]
    log = spark.createDataFrame(rows, "pos long, type string, table_name string")
    assert [tuple(r)[:2] for r in statements.simplify(log).collect()] == [(4, "CreateTable"), (5, "Insert"), (7, "DropTable")]
    with pytest.raises(ValueError):
        statements.pipeline(log, "nothing")
    log.write.parquet(str(tmp_path / "in"))
    streaming.keep_latest(streaming.arriving(spark, str(tmp_path / "in"), log.schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert {(r.table_name, r.pos) for r in streaming.current(spark, str(tmp_path / "out")).collect()} == {("a", 5), ("b", 7)}


def test_schema_differences(spark):
    cat = "table_name string, column_name string, sql_type string, nullable boolean, default_text string"
    old = spark.createDataFrame([("t", "a", "NUMBER(10)", True, None), ("t", "b", "TEXT", True, "1"), ("gone", "x", "INT", True, None)], cat)
    new = spark.createDataFrame([("T", "A", "integer", True, None), ("T", "B", "TEXT", False, "1"), ("T", "C", "DATE", True, None)], cat)
    assert got(schemadiff.diff_columns(old, new).select("op", "table_name", "column_name", "change")) == [("ADD", "T", "C", None), ("MODIFY", "T", "B", "nullable: true -> false")]
    assert got(schemadiff.diff_tables(old, new)) == [("DROP", "GONE")]
    assert schemadiff.diff_columns(old, old).isEmpty()


def test_types_masks_and_names(spark):
    assert [schemadiff.spark_type(x) for x in ("NUMBER(*,2)", "varchar2(20 char)", "TEXT[]", "decimal(5,2)", "TIMESTAMP(6) WITH TIME ZONE")] == ["decimal(38,2)", "string", "array<string>", "decimal(5,2)", "timestamp"]
    with pytest.raises(ValueError):
        schemadiff.spark_type("NOPE")
    assert fn.mask("DD.MM.YYYY HH24:MI:SS") == "dd.MM.yyyy HH:mm:ss"
    m = spark.sql(r"SELECT '@A: 1\n@B: x \\\n y\n@A: 2' AS c").select(fn.metadata(F.col("c")).alias("m")).first().m
    assert m == {"A": "2", "B": "x y"}
    assert tables.glob_to_regex("a/**/b?.sql") == r"^a/(.+)/b[^/]\.sql$" and tables.like_to_regex("A_%") == "(?i)^A..*$"


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "x.sql").write_text("CREATE TABLE a (v TEXT DEFAULT ';'); -- not; this\n/* nor; that * */ INSERT INTO a VALUES ('it''s');\n\n;")
    assert [r.text for r in tables.statement_files(spark, str(tmp_path)).orderBy("pos").collect()] == ["CREATE TABLE a (v TEXT DEFAULT ';')", "INSERT INTO a VALUES ('it''s')"]
    d = spark.sql("SELECT 1 AS a, 'it''s' AS b, DATE '2020-01-02' AS c, CAST(NULL AS INT) AS d, true AS e")
    assert sinks.insert_batches(d, "t", ["a"]).first().statement == "INSERT INTO t (a, b, c, d, e) VALUES\n(1, 'it''s', DATE '2020-01-02', NULL, TRUE);"
    assert sinks.insert_batches(d.limit(0), "t", ["a"]).isEmpty()


def test_commands(spark, tmp_path):
    from granary import cli

    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "it's"), (4, None)], "k int, v string")
    old.write.parquet(str(tmp_path / "old"))
    new.write.parquet(str(tmp_path / "new"))
    run = lambda *a: cli.run(cli.parser().parse_args(list(a)), spark)
    two = ["t", str(tmp_path / "old"), str(tmp_path / "new"), "--key", "K"]
    assert [r.statement for r in run("data-plan", *two).collect()] == ["UPDATE t SET v = 'it''s' WHERE k = 2;", "DELETE FROM t WHERE k = 3;", "INSERT INTO t (k, v) VALUES (4, NULL);"]
    assert run("data-diff", *two, "--keep").filter("op = 'DELETE'").isEmpty()
    assert run("apply", *two, "--out", str(tmp_path / "out")) is None and got(spark.read.parquet(str(tmp_path / "out"))) == got(new)
    new.drop("v").withColumn("w", F.lit(1)).write.parquet(str(tmp_path / "wide"))
    steps = run("plan", "--old", f"t={tmp_path}/old", "--new", f"t={tmp_path}/wide", f"u={tmp_path}/new").collect()
    assert [(r.table_name, r.step, r.reverse) for r in steps] == [("T", "ADD COLUMN", "DROP COLUMN"), ("T", "DROP COLUMN", None), ("U", "CREATE TABLE", "DROP TABLE")]
    assert run("inspect", f"t={tmp_path}/old").count() == 2
    assert run("dump", "t", str(tmp_path / "old"), "--key", "k").count() >= 1 and run("dump", "t", str(tmp_path / "old"), "--key", "k", "--json").count() == 4


def test_shown_rows_are_counted(spark, tmp_path, monkeypatch, capsys):
    from granary import cli

    monkeypatch.setattr(cli, "session", lambda name: spark)
    monkeypatch.setattr(cli, "SHOWN", 2)
    spark.range(5).write.parquet(str(tmp_path / "t"))
    cli.main(["dump", "t", str(tmp_path / "t"), "--key", "id", "--json"])
    out = capsys.readouterr()
    assert len(out.out.splitlines()) == 2 and "4 more rows" in out.err
    cli.main(["dump", "t", str(tmp_path / "t"), "--key", "id", "--json", "--write", str(tmp_path / "all")])
    assert spark.read.json(str(tmp_path / "all")).count() == 6
