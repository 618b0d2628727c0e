"""Views kept by changes equal views computed anew; a replayed log gives what running it gives."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import replay, rowdiff, views

ALL = {"c": ("count", "v"), "s": ("sum", "v"), "a": ("avg", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "first": ("min", "t")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def states(spark, seed):
    rnd = random.Random(seed)
    one = {k: (k, rnd.choice(["x", "y", None]), rnd.choice([None, 1.0, 2.0, 2.5, 9.0]), rnd.choice([None, "p", "q"])) for k in range(120)}
    two = {k: (k, rnd.choice([r[1], "z"]), rnd.choice([r[2], r[2], 3.0, -1.0]), r[3]) if rnd.random() < 0.3 else r for k, r in one.items() if rnd.random() > 0.2}
    two |= {k: (k, "w" if k % 2 else "x", 4.0, "q") for k in range(200, 220)}
    return [spark.createDataFrame(list(d.values()), "k int, g string, v double, t string") for d in (one, two)]


@pytest.mark.parametrize("groups", [("g",), ("g", "t"), ()])
def test_view_is_that_of_the_new_state(spark, groups):
    view = views.View(groups, ALL)
    old, new = states(spark, len(groups))
    for a, b in ((old, new), (new, old)) if groups == ("g",) else ((old, new),):
        changes = views.signed(rowdiff.diff(a, b, ["k"]), ["k"])
        state = views.apply(views.build(a, view), changes, b, view)
        assert rows(views.show(state, view)) == rows(views.show(views.build(b, view), view))
        assert state.columns == views.build(b, view).columns


def test_rows_below_are_not_read_unless_an_end_is_lost(spark):
    view = views.View(("g",), {"lo": ("min", "v")})
    old = spark.createDataFrame([(1, "x", 5), (2, "x", 7), (3, "y", 1)], "k int, g string, v int")
    poison = old.withColumn("v", F.raise_error(F.lit("read")).cast("int"))
    changes = spark.createDataFrame([(2, "x", 7, -1), (4, "x", 6, 1), (5, "y", 0, 1), (3, "y", 1, -1), (9, "z", 8, 1), (9, "z", 8, -1), (8, "x", 0, 1), (8, "x", 0, -1)], "k int, g string, v int, _sign int")
    assert rows(views.show(views.apply(views.build(old, view), changes, poison, view), view)) == [("x", 2, 5), ("y", 1, 0)]
    with pytest.raises(Exception, match="read"):
        views.apply(views.build(old, view), changes.filter("k = 3").withColumn("v", F.lit(5)).withColumn("g", F.lit("x")), poison, view).collect()
    with pytest.raises(ValueError, match="median"):
        views.View(("g",), {"m": ("median", "v")})


def test_view_of_a_join(spark):
    view = views.View(("g", "name"), {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "w")})
    old, new = states(spark, 7)
    right = spark.createDataFrame([("p", "one", 1), ("q", "two", 2), ("q", "more", 3)], "t string, name string, w int")
    now = spark.createDataFrame([("p", "one", 1), ("q", "two", 0), ("z", "new", 3)], "t string, name string, w int")
    changes = views.joined(old, views.signed(rowdiff.diff(old, new, ["k"]), ["k"]), now, views.signed(rowdiff.diff(right, now, ["t", "name"]), ["t", "name"]), ["t"])
    state = views.apply(views.build(old.join(right, "t"), view), changes, new.join(now, "t"), view)
    assert rows(views.show(state, view)) == rows(views.show(views.build(new.join(now, "t"), view), view))


LOG = "pos long, type string, name string, new_name string, attribute string, value string"


def run(log, position):
    """(object, name, attribute, value) by running the log."""
    bound, attributes = {}, {}
    for pos, kind, name, new, attribute, value in sorted(log):
        if pos > position:
            break
        if kind == "CREATE":
            bound[name] = pos
        elif kind == "DROP":
            bound[name] = None
        elif kind == "RENAME":
            thing = bound.get(name)
            bound[name] = None
            bound[new] = thing
        elif bound.get(name) is not None:
            attributes.setdefault(bound[name], {})[attribute] = value
    out = []
    for name, thing in bound.items():
        if thing is not None:
            out += [(thing, name, a, v) for a, v in attributes.get(thing, {None: None}).items()]
    return sorted(out, key=str)


@pytest.mark.parametrize("names,bins", [(3, 4), (12, 256)])
def test_replay_gives_what_running_gives(spark, monkeypatch, names, bins):
    rnd = random.Random(names)
    log = []
    for pos in range(0, 1200, 3):
        kind = rnd.choice(["CREATE", "DROP", "RENAME", "RENAME", "RENAME", "ALTER", "COMMENT", "ALTER"])
        log.append((pos, kind, f"n{rnd.randrange(names)}", f"n{rnd.randrange(names)}" if kind == "RENAME" else None, rnd.choice(["a", "b", None]), rnd.choice([None, str(pos)])))
    find = replay.last_before
    monkeypatch.setattr(replay, "last_before", lambda *a: find(*a, bins))
    bindings, changes = replay.resolve(spark.createDataFrame(log, LOG))
    for position in (-1, 0, 100, 601, 5000):
        assert rows(replay.as_of(bindings, changes, position)) == run(log, position)


def test_long_chains_and_empty_logs(spark):
    log = [(0, "CREATE", "c0", None, None, None), (1, "COMMENT", "c0", None, "note", "old")]
    log += [(i + 2, "RENAME", f"c{i}", f"c{i + 1}", None, None) for i in range(100)] + [(200, "COMMENT", "c100", None, "note", "new"), (201, "RENAME", "gone", "c7", None, None), (202, "COMMENT", "c7", None, "note", "lost")]
    bindings, changes = replay.resolve(spark.createDataFrame(log, LOG))
    for position in (50, 150, 300):
        assert rows(replay.as_of(bindings, changes, position)) == run(log, position)
    empty = replay.resolve(spark.createDataFrame([], LOG))
    assert replay.as_of(*empty, 5).isEmpty()
