"""Transformations of a log of statements: rows (pos, type, table_name, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types that carry no change, and the order of types in sorted output.
NOISE = ("Set", "Prompt", "Select", "Commit")
DROPPED_WITH_TABLE = ("Insert", "Update", "Delete", "AlterTable", "CreateIndex")
PRIORITY = {"CreateTable": 0, "CreateIndex": 1, "CreateView": 2, "AlterTable": 4, "Grant": 5, "Revoke": 6, "Insert": 7, "Update": 8, "Delete": 9, "Comment": 10, "DropTable": 13}
SYNC_PRIORITY = {"DropTable": 0, "DropIndex": 1, "AlterTable": 2, "CreateTable": 3, "CreateIndex": 4, "DeleteRow": 5, "UpdateRow": 6, "InsertRow": 7, "Insert": 8}
SYNC_OTHER = 9


def priority(kind: Column, order: dict[str, int] = PRIORITY, other: int = 99) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k in order.items() for x in k)), kind), F.lit(other))


def drop_noise(log: DataFrame) -> DataFrame:
    return log.filter(~F.col("type").isin(*NOISE))


def _last(kind: str) -> Column:
    return F.max(F.when(F.col("type") == kind, F.col("pos")))


def _with_last(log: DataFrame, **kinds: str) -> DataFrame:
    """log with the last position of types for the statement's table. Aggregated and joined, so a table with very many statements is no large group."""
    last = log.filter(F.col("type").isin(*kinds.values())).groupBy(F.col("table_name").alias("_t")).agg(*(_last(k).alias(c) for c, k in kinds.items()))
    return log.join(last, F.col("table_name") == F.col("_t"), "left").drop("_t")


def drop_optimize(log: DataFrame) -> DataFrame:
    """Without changes to a table that stand before its last DROP."""
    gone = F.col("type").isin(*DROPPED_WITH_TABLE) & (F.col("pos") < F.col("_drop"))
    return _with_last(log, _drop="DropTable").filter(~F.coalesce(gone, F.lit(False))).drop("_drop")


def dedupe(log: DataFrame) -> DataFrame:
    """Without DROPs of tables that are created again, and with only the last CREATE of a table."""
    again = (F.col("type") == "DropTable") & F.col("_create").isNotNull()
    old = (F.col("type") == "CreateTable") & (F.col("pos") < F.col("_create"))
    return _with_last(log, _create="CreateTable").filter(~F.coalesce(again | old, F.lit(False))).drop("_create")


def sort(log: DataFrame, order: dict[str, int] = PRIORITY) -> DataFrame:
    """By the types' priority; ties stay in order."""
    return log.orderBy(priority(F.col("type"), order), "pos")


def exclude(log: DataFrame, types: str) -> DataFrame:
    """Without the types named, separated by |."""
    return log.filter(~F.col("type").isin(*types.split("|")))


def simplify(log: DataFrame) -> DataFrame:
    return log.transform(drop_noise).transform(drop_optimize).transform(dedupe).transform(sort)


#: Transformations by name; exclude:A|B takes types.
NAMED: dict[str, Callable[[DataFrame], DataFrame]] = {"filter": drop_noise, "drop-optimize": drop_optimize, "dedupe": dedupe, "sort": sort}


def pipeline(log: DataFrame, names: str) -> DataFrame:
    """Applies transformations in turn, named in a text and separated by commas."""
    for name in filter(None, (x.strip() for x in names.split(","))):
        if name.startswith("exclude:"):
            log = exclude(log, name.partition(":")[2])
        elif name in NAMED:
            log = log.transform(NAMED[name])
        else:
            raise ValueError(f"no transformation {name!r}; there are {', '.join(NAMED)} and exclude:TYPES")
    return log


def report(log: DataFrame) -> DataFrame:
    """(file, n_ok, n_failed, n_total) for each file, and for all with a null file."""
    return log.rollup("file").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.count("*").alias("n_total"))


def last_per_table(log: DataFrame, kind: str = "CreateTable") -> DataFrame:
    """The last statement of a type for each table."""
    rest = [c for c in log.columns if c != "table_name"]
    return log.filter(F.col("type") == kind).groupBy("table_name").agg(F.max_by(F.struct(*rest), "pos").alias("_s")).select("table_name", "_s.*")


def ranked(log: DataFrame, order: dict[str, int] = PRIORITY, other: int = 99, ranges: int = 1024) -> DataFrame:
    """log with `prio` and `place`, from 1, in the order by priority and pos. Places come from counts of ranges of pos for each priority and from row numbers within these, so that no task numbers a whole priority."""
    d = log.withColumn("prio", priority(F.col("type"), order, other))
    ends = d.agg(F.min("pos").alias("_low"), F.max("pos").alias("_high"))  # one row
    d = d.join(F.broadcast(ends)).withColumn("_range", F.floor((F.col("pos") - F.col("_low")).cast("double") * ranges / (F.col("_high") - F.col("_low") + 1))).drop("_low", "_high")
    before = Window.orderBy("prio", "_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each priority and range
    counts = d.groupBy("prio", "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    d = d.join(F.broadcast(counts), ["prio", "_range"])  # `ranges` rows for each priority
    place = F.row_number().over(Window.partitionBy("prio", "_range").orderBy("pos")) + F.col("_before")
    return d.withColumn("place", place.cast("bigint")).drop("_range", "_before")
