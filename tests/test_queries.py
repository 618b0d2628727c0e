"""Every query with SQL gives the same rows in DuckDB; all have one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from granary.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, values):
    def plain(x):
        return None if x is None or x != x else repr(round(x, 6)) if isinstance(x, float) else str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(v[i]) for i in order) for v in values), key=lambda r: tuple(x or "" for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf_dir, duck, name):
    d = QUERIES[name](spark, sf_dir)
    rel = duck.sql(ORACLES[name])
    assert rows(d.columns, [tuple(r) for r in d.collect()]) == rows(rel.columns, rel.fetchall())


def test_contract(spark):
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(entry.ENTRY_DIR) and entry.entry(spark).count() > 0
