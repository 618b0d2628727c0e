"""Replaying a log of changes to objects: which object a name meant at each position, and the catalog at any position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.ranges import bounds_of
from granary.scratch import stored

#: Types of a log's rows. Others (COMMENT, ALTER, ...) set `attribute` of the object to `value`.
CREATE, DROP, RENAME = "CREATE", "DROP", "RENAME"


def last_before(rows: DataFrame, events: DataFrame, key: str, event: str, bins: int = 256) -> DataFrame:
    """rows (with `pos` and the key) with the struct column `event` of the last of events, by `pos`, with an equal key and a smaller position; null if there is none.

    Positions are binned. The last event of each key and bin is carried to later bins over a table of these, and only rows and events of one
    key and one bin are sorted together, so a key of any size is spread over the bins.
    """
    at = bounds_of(events, "pos", bins)
    names = rows.columns
    both = rows.select(F.col(key).alias("_k"), F.col("pos").alias("_p"), F.struct(*names).alias("_row"), F.lit(None).cast(events.schema[event].dataType).alias("_e"))
    both = both.unionByName(events.select(F.col(key).alias("_k"), F.col("pos").alias("_p"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(event).alias("_e")))
    both = both.withColumn("_b", at.upto(F.col("_p")))
    ends = both.filter("_e is not null").groupBy("_k", "_b").agg(F.max_by("_e", "_p").alias("_end"))
    span = both.select("_k", "_b").distinct().join(ends, ["_k", "_b"], "left")
    carried = span.withColumn("_before", F.last("_end", True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each bin of a key
    # A position's row stands before its event: an event is seen by later positions only.
    near = F.last("_e", True).over(Window.partitionBy("_k", "_b").orderBy("_p", F.col("_e").isNotNull()).rowsBetween(Window.unboundedPreceding, -1))
    d = both.withColumn("_near", near).filter("_row is not null").join(carried.select("_k", "_b", "_before"), ["_k", "_b"], "left")
    return d.select("_row.*", F.coalesce("_near", "_before").alias(event))


def resolve(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings, changes) of a log (pos, type, name, new_name, attribute, value) with unique positions.

    A name is bound by CREATE, and by RENAME to it; it is free after DROP, after RENAME from it, and when what it was bound to was renamed from a free name. What was bound to a name
    before is gone when the name is bound anew. bindings: (pos, name, until, object): from pos on, and before until (null: to the end), the name means the object, which
    is named by the position of its CREATE. changes: (pos, object, attribute, value), each of the object that its name meant; those of free names are left out.

    The binding that a renamed name had is its parent. Roots of these chains are found by pointer jumping: each round doubles the distance, so a chain of n renames takes about log2(n) rounds.
    """
    log = log.select("pos", "type", "name", "new_name", "attribute", "value")
    binds = log.filter(F.col("type").isin(CREATE, RENAME)).select("pos", F.when(F.col("type") == CREATE, F.col("name")).otherwise(F.col("new_name")).alias("name"), F.lit(True).alias("bound"), "type", F.col("name").alias("source"))
    frees = log.filter(F.col("type").isin(DROP, RENAME)).filter("type = 'DROP' or not (name <=> new_name)").select("pos", "name", F.lit(False).alias("bound"), "type", F.lit(None).cast("string").alias("source"))
    events = stored(binds.unionByName(frees).filter("name is not null").select("pos", "name", "type", "source", F.struct("pos", "bound").alias("event")), "name-events")
    # Parents: for each rename, what its source was bound to.
    nodes = events.filter("event.bound").select("pos", "type", F.col("source").alias("name"))
    lookups = last_before(nodes.filter("type = 'RENAME'"), events.select("pos", "name", "event"), "name", "event")
    parents = lookups.select("pos", F.when(F.col("event.bound"), F.col("event.pos")).alias("up"))
    roots = nodes.filter("type = 'CREATE'").select("pos", F.col("pos").alias("up"), F.lit(True).alias("done"))
    # A rename of a free name is done, at no object.
    chains = stored(roots.unionByName(parents.select("pos", "up", F.col("up").isNull().alias("done"))), "chains")
    while not chains.filter("not done").isEmpty():
        up = chains.select(F.col("pos").alias("_pos"), F.col("up").alias("_up"), F.col("done").alias("_done"))
        todo = chains.filter("not done").join(up, F.col("up") == F.col("_pos")).select("pos", F.col("_up").alias("up"), F.col("_done").alias("done"))
        chains = stored(chains.filter("done").unionByName(todo), "chains")
    objects = chains.filter("up is not null").select(F.col("pos").alias("_pos"), F.col("up").alias("object"))
    # Until when: the next event of the name, which is the last before it when positions run backwards.
    back = events.select((-F.col("pos")).alias("pos"), "name", F.struct((-F.col("pos")).alias("pos")).alias("after"))
    after = last_before(events.filter("event.bound").select((-F.col("pos")).alias("pos"), "name"), back, "name", "after")
    bindings = after.select((-F.col("pos")).alias("pos"), "name", (-F.col("after.pos")).alias("until")).join(objects, F.col("pos") == F.col("_pos")).select("pos", "name", "until", "object")
    changes = last_before(log.filter(~F.col("type").isin(CREATE, DROP, RENAME)).select("pos", "name", "attribute", "value"), events.select("pos", "name", "event"), "name", "event")
    changes = changes.filter("event.bound").join(objects, F.col("event.pos") == F.col("_pos")).select("pos", "object", "attribute", "value")
    return bindings, changes


def as_of(bindings: DataFrame, changes: DataFrame, position: int) -> DataFrame:
    """(object, name, attribute, value): the objects that had a name after the statement at `position`, with the last value of each attribute; one row without attribute for those that have none."""
    alive = bindings.filter((F.col("pos") <= position) & (F.col("until").isNull() | (F.col("until") > position))).select("object", "name")
    last = changes.filter(F.col("pos") <= position).groupBy("object", "attribute").agg(F.max_by("value", "pos").alias("value"))
    return alive.join(last, "object", "left")
