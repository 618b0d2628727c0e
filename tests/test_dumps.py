"""Splitting dumps in ranges gives what one scan of the whole file gives."""

import random
import re

import pytest

from granary.sources import dumps, tables

TOKEN = re.compile(r"'(?:[^']|'')*(?:'|\Z)|\"[^\"]*(?:\"|\Z)|--[^\n]*|/\*.*?(?:\*/|\Z)|(?<=\n)[ \t]*/[ \t]*(?=\r?\n|\Z)|.", re.S)
LEAD = re.compile(r"(?:\s|--[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z))*", re.S)


def sequential(text, slash=False):
    """(pos, start, end, text, closed), by one scan; places in bytes."""
    out, begin, at = [], 0, 0
    unclosed = False

    def put(stop):
        piece = text[begin:stop]
        lead = LEAD.match(piece).end()
        body = piece[lead:].rstrip()
        if body:
            start = len(text[: begin + lead].encode())
            out.append((len(out), start, start + len(body.encode()), body, not (unclosed and stop == len(text))))

    while at < len(text):
        m = TOKEN.match(text, at)
        t = m[0]
        at = m.end()
        if t == ";" or slash and t.strip(" \t") == "/" and (m.start() and text[m.start() - 1] == "\n") and re.match(r"\r?\n|\Z", text[at:]):
            put(m.start())
            begin = at
        elif at == len(text):
            unclosed = t[0] == "'" and (len(t) == 1 or t.count("'") % 2) or t[0] == '"' and (len(t) == 1 or t[-1] != '"') or t.startswith("/*") and (len(t) < 4 or not t.endswith("*/")) or t.startswith("--")
    put(len(text))
    return out


def dump(seed, size):
    rnd = random.Random(seed)
    words = ["a", "INSERT INTO t VALUES (1)", ";", ";", ";", "'", "''", '"', "--", "\n", "\n", "/*", "*/", " ", "é", "-", "/", "*", "\n/\n", "\r\n", "x;y", "'it''s; quoted'", "-- said; \n", "/* a; ' */", '"col;umn"']
    return "".join(rnd.choice(words) for _ in range(size))


@pytest.fixture()
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("slash", [False, True])
def test_ranges_give_what_one_scan_gives(spark, tmp_path, small_ranges, monkeypatch, slash):
    monkeypatch.setattr(dumps, "GROUP_BYTES", 300)
    texts = [dump(s, 250) for s in (1, 2, 3)] + ["", ";", "no end", "'never closed; " + "a;" * 80]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.sql").write_bytes(t.encode())
    made = dumps.split_statements(spark, str(tmp_path), slash=slash)
    got = {i: [] for i in range(len(texts))}
    for r in dumps.numbered(made).collect():
        got[int(re.search(r"f(\d+)\.sql", r.file)[1])].append((r.pos, r.start, r.end, r.text, r.closed))
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sequential(t, slash), (i, t)
    assert made.select("range").distinct().count() > 5


def test_other_joins_and_long_statements(spark, tmp_path, small_ranges, monkeypatch):
    text = "first; 'open " + "b;" * 100 + "' end; last"
    (tmp_path / "a.sql").write_text(text)
    rows = lambda d: sorted(tuple(r)[1:] for r in dumps.numbered(d).collect())
    want = rows(dumps.split_statements(spark, str(tmp_path)))
    assert [r[3] for r in want] == ["first", "'open " + "b;" * 100 + "' end", "last"]
    monkeypatch.setattr(dumps, "BROADCAST_RANGES", 0)
    assert rows(dumps.split_statements(spark, str(tmp_path))) == want
    short = rows(dumps.split_statements(spark, str(tmp_path), most_bytes=100))
    assert [r[3] for r in short] == ["first", None, "last"] and [r[0] for r in short] == [0, 1, 2] and short[1][2] >= want[1][2]


def test_statement_files_without_comments(spark, tmp_path):
    (tmp_path / "a.sql").write_text("-- head; \nCREATE TABLE t /* no; */ (a text DEFAULT ';--');\n\n; SELECT 1 -- one\n")
    assert [tuple(r)[1:] for r in tables.statement_files(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "CREATE TABLE t  (a text DEFAULT ';--')"), (1, "SELECT 1")]
