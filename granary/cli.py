"""Commands: python -m granary.cli inspect | plan | data-diff | data-plan | apply | dump, on Parquet tables by path."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import rowdiff, schemadiff
from granary.session import session
from granary.sources import sinks


#: Rows that go to the screen.
SHOWN = 1000


def _read(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Tables by name, from arguments NAME=PATH."""
    return {n: spark.read.parquet(p) for n, _, p in (x.partition("=") for x in paths)}


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame | None:
    """The command's result as a table; None for those that only write."""
    if args.command == "inspect":
        return schemadiff.catalog_of(spark, _read(spark, args.table))
    if args.command == "plan":
        old, new = (schemadiff.catalog_of(spark, _read(spark, x)) for x in (args.old, args.new))
        tables = schemadiff.migration_steps(schemadiff.diff_tables(old, new).withColumn("what", F.lit(None).cast("string")), "TABLE")
        columns = schemadiff.migration_steps(schemadiff.diff_columns(old, new).withColumn("what", F.concat_ws(" ", "column_name", "change")), "COLUMN")
        return tables.unionByName(columns.select(tables.columns)).orderBy("table_name", "step", "what")
    if args.command == "dump":
        df = spark.read.parquet(args.path)
        return sinks.json_dump(df, args.schema, args.name) if args.json else sinks.insert_batches(df, args.name, args.key, args.batch, args.dialect).orderBy("part", "batch").select("statement")
    old, new = spark.read.parquet(args.old_path), spark.read.parquet(args.new_path)
    key = rowdiff.key_of(args.name, new, args.key)
    repeated = rowdiff.duplicates(old, key)
    if not repeated.isEmpty():
        raise rowdiff.DiffError(f"{args.name}: keys repeat in the old state, e.g. {repeated.first()}")
    changes = rowdiff.diff(old, new, key, not args.keep)
    if args.command == "data-diff":
        return changes
    if args.command == "data-plan":
        return sinks.change_statements(changes, args.name, key, args.dialect).orderBy(*key)
    rowdiff.apply_changes(old, changes, key).write.parquet(args.out)
    return None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="granary", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("inspect", help="the columns of tables")
    x.add_argument("table", nargs="+", metavar="NAME=PATH")
    x = sub.add_parser("plan", help="schema changes from old to new tables")
    for side in ("--old", "--new"):
        x.add_argument(side, nargs="+", required=True, metavar="NAME=PATH")
    for name, what in (("data-diff", "changed rows"), ("data-plan", "statements that change them"), ("apply", "write the changed table to a new folder")):
        x = sub.add_parser(name, help=what)
        x.add_argument("name")
        x.add_argument("old_path")
        x.add_argument("new_path")
        x.add_argument("--key", nargs="+", required=True)
        x.add_argument("--keep", action="store_true", help="delete nothing")
        if name == "apply":
            x.add_argument("--out", required=True)
    x = sub.add_parser("dump", help="a table as INSERT statements or JSON")
    x.add_argument("name")
    x.add_argument("path")
    x.add_argument("--key", nargs="+", required=True)
    x.add_argument("--batch", type=int, default=1000)
    x.add_argument("--json", action="store_true")
    x.add_argument("--schema", default="public", help="for the header of JSON")
    for x in sub.choices.values():
        x.add_argument("--dialect", choices=("ansi", "postgres", "oracle"), default="ansi")
        x.add_argument("--write", help=f"folder for the whole result, as JSON; else its first {SHOWN} rows are shown")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    out = run(args, session(f"granary {args.command}"))
    if out is not None and args.write:
        out.write.json(args.write)
    elif out is not None:
        for row in out.limit(SHOWN + 1).collect()[:SHOWN]:
            print("\t".join("" if v is None else str(v) for v in row))
        rest = out.count() - SHOWN
        if rest > 0:
            print(f"{rest} more rows are not shown; --write FOLDER writes all", file=sys.stderr)


if __name__ == "__main__":
    main()
