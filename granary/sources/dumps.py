"""Statements of SQL dumps, split in parallel: a file of any size is read in ranges, and what state each range begins in is found by composing the ranges before it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.scratch import stored

#: Ranges that are broadcast at most; more of them are joined by shuffling.
BROADCAST_RANGES = 100_000
#: Bytes of a file whose ranges are composed in one task.
GROUP_BYTES = 1 << 36
#: Longer statements keep their place but no text.
MOST_BYTES = 1 << 28

# What opens a quote or comment, and what closes it. State 0 is outside of all.
OPENS = {b"'": 1, b'"': 2, b"--": 3, b"/*": 4}
CLOSES = (b"", b"'", b'"', b"\n", b"*/")
_OPEN = re.compile(rb"'|\"|--|/\*")
_OPEN_OR_SLASH = re.compile(rb"'|\"|--|/\*|\n[ \t]*/[ \t]*(?=\r?\n|\Z)")
_LEAD = re.compile(rb"(?:\s+|--[^\n]*(?:\n|\Z)|/\*(?:.*?\*/|.*\Z))*", re.S)
_COMMENT = re.compile(rb"('(?:[^']|'')*'|\"[^\"]*\")|--[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_SEGMENT = "file string, range long, nth long, begin long, at long, end long, text binary, first boolean, last boolean, closed boolean"
_STATEMENT = "file string, range long, nth long, start long, end long, text string, closed boolean"


def _walk(piece: bytes, state: int, slash: bool) -> tuple[int, list[int]]:
    """The state after a piece that begins in `state`, and where statements end in it at a slash that has its line alone."""
    at, cuts, token = 0, [], _OPEN_OR_SLASH if slash else _OPEN
    while True:
        if state:
            i = piece.find(CLOSES[state], at)
            if i < 0:
                return state, cuts
            at, state = i + (state == 4) + (state != 3), 0  # a comment's line end may begin a slash line
        m = token.search(piece, at)
        if not m:
            return 0, cuts
        at, state = m.end(), OPENS.get(m[0], 0)
        if not state:
            cuts.append(at)


class Range(NamedTuple):
    """What a range of a file does: its bytes; for each state that it may begin in, the state after it, and how many bytes after its begin the statement begins that is open then (-1: it was open before)."""

    size: int
    ends: list[int]
    opens: list[int]

    def then(self, other: Range) -> Range:
        opens = [other.opens[e] + self.size if other.opens[e] >= 0 else o for e, o in zip(self.ends, self.opens, strict=True)]
        return Range(self.size + other.size, [other.ends[e] for e in self.ends], opens)


NOTHING = Range(0, [0, 1, 2, 3, 4], [-1] * 5)


def _range_of(piece: bytes, slash: bool) -> Range:
    """A piece and the semicolon after it."""
    ends, opens = [], []
    for state in range(5):
        end, cuts = _walk(piece, state, slash)
        ends.append(end)
        opens.append(len(piece) + 1 if end == 0 else cuts[-1] if cuts else -1)
    return Range(len(piece) + 1, ends, opens)


def _ranges(pieces: DataFrame, slash: bool) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "range", "size", "ends", "opens"]
        row = lambda k, r: pa.RecordBatch.from_arrays([pa.array([k[0]]), pa.array([k[1]], pa.int64()), pa.array([r.size], pa.int64()), pa.array([r.ends], pa.list_(pa.int64())), pa.array([r.opens], pa.list_(pa.int64()))], names=names)
        held, key = NOTHING, None
        for b in batches:
            for *at, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if at != key:
                    if key:
                        yield row(key, held)
                    held, key = NOTHING, at
                held = held.then(_range_of(piece, slash))
        if key:
            yield row(key, held)

    return pieces.mapInArrow(read, "file string, range long, size long, ends array<long>, opens array<long>")


def _rows(p: pd.DataFrame) -> list[Range]:
    return [Range(int(s), list(e), list(o)) for s, e, o in zip(p["size"], p["ends"], p["opens"], strict=True)]


def _scan(ranges: DataFrame) -> DataFrame:
    """(file, range, state, offset, begin): what each range begins with. A prefix scan in two levels: over ranges within groups of a file, over a file's groups."""
    grouped = ranges.withColumn("group", F.expr(f"range div {GROUP_BYTES}L"))

    def total(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        r = reduce(Range.then, _rows(p.sort_values("range")), NOTHING)
        return pd.DataFrame([(*key, *r)], columns=["file", "group", "size", "ends", "opens"])

    def starts(p: pd.DataFrame, at: tuple[int, int, int], number: str) -> pd.DataFrame:
        state, offset, begin = at
        p, out = p.sort_values(number), []
        for r in _rows(p):
            out.append((state, offset, begin))
            begin = offset + r.opens[state] if r.opens[state] >= 0 else begin
            state, offset = r.ends[state], offset + r.size
        return pd.concat([p[["file", number]].reset_index(drop=True), pd.DataFrame(out, columns=["state", "offset", "begin"])], axis=1)

    groups = grouped.groupBy("file", "group").applyInPandas(total, "file string, group long, size long, ends array<long>, opens array<long>")
    groups = groups.groupBy("file").applyInPandas(lambda p: starts(p, (0, 0, 0), "group"), "file string, group long, state long, offset long, begin long")
    own = grouped.join(groups, ["file", "group"])
    return own.groupBy("file", "group").applyInPandas(lambda p: starts(p, tuple(p.iloc[0][["state", "offset", "begin"]]), "range"), "file string, range long, state long, offset long, begin long")


def _statement(text: bytes, begin: int, comments: bool) -> tuple[int, int, bytes]:
    """(start, end, text) of a statement without the blanks and comments before it and the blanks after it."""
    lead = _LEAD.match(text).end()
    body = text[lead:].rstrip()
    return begin + lead, begin + lead + len(body), body if comments else _COMMENT.sub(lambda m: m[1] or b"", body).strip()


def split_statements(spark: SparkSession, path: str, glob: str = "*.sql", slash: bool = False, comments: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(file, range, nth, start, end, text, closed): what stands between semicolons that are in no quotes and no comment, with the bytes where it starts and ends.

    Blanks and comments before a statement are left out, and statements of nothing else; `comments` keeps those within. With `slash` a line of one slash ends a
    statement too. The last statement of a file needs no semicolon; `closed` is false where a quote or comment is open at its end. `nth` numbers the
    statements that begin in a range; `numbered` gives their places in the file.

    Files are read in ranges of spark.sql.files.maxPartitionBytes, twice: first each range is scanned from all five states it may begin in, which
    gives a map from states to states; the maps are composed, and then each range is cut by the state it begins in. Only parts of statements over the
    edge of a range are shuffled. A statement of over `most_bytes` has a null text, so that a quote that is never closed does not put the rest of a dump into one row.
    """
    raw = spark.read.option("lineSep", ";").option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    m = F.col("_metadata")
    pieces = raw.select(m["file_path"].alias("file"), m["file_block_start"].alias("range"), m["file_size"].alias("bytes"), F.col("value").cast("binary").alias("piece"))
    starts = stored(_scan(_ranges(pieces, slash)), "dump-ranges")
    if starts.count() <= BROADCAST_RANGES:
        d = pieces.join(F.broadcast(starts), ["file", "range"])  # keeps the order of pieces
    else:
        d = pieces.withColumn("n", F.monotonically_increasing_id()).join(starts, ["file", "range"]).repartition("file", "range").sortWithinPartitions("file", "range", "n")
    d = d.select("file", "range", "bytes", "piece", "state", "offset", "begin")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = offset = begin = at = nth = first = None
        held: list[bytes] = []
        kinds = [pa.string(), *[pa.int64()] * 5, pa.binary(), *[pa.bool_()] * 3]
        names = [x.split()[0] for x in _SEGMENT.split(", ")]
        rows: list[tuple] = []

        def put(part: bytes, last: bool) -> None:
            """Ends the segment with part; `last` if the statement ends there."""
            nonlocal held, begin, at, nth, first
            text = b"".join([*held, part])
            if not (first and last) or _LEAD.match(text).end() < len(text):
                rows.append((*key, nth if first else -1, begin, at, at + len(text), text, first, last, state == 0))
                nth += first
            held, first = [], True

        for b in batches:
            for file, number, size, piece, *start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (file, number):
                    if held:
                        put(b"", False)
                    key, nth = (file, number), 0
                    state, offset, begin = start
                    at, first = offset, begin == offset
                end, cuts = _walk(piece, state, slash)
                done = offset + len(piece) >= size  # no semicolon after it
                low = 0
                for c in cuts:
                    state = 0
                    put(piece[low:c].rstrip()[:-1], True)
                    begin = at = offset + c
                    low = c
                state = end
                if end == 0 or done:
                    put(piece[low:], True)
                    begin = at = offset + len(piece) + 1
                else:
                    held.append(piece[low:] + b";")
                offset += len(piece) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if held:
            put(b"", False)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, number, nth, begin, end, text, closed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text is None:
                    rows.append((file, number, nth, begin, end, None, closed))
                    continue
                start, end, body = _statement(text, begin, comments)
                if body:
                    rows.append((file, number, nth, start, end, body, closed))
            kinds = [pa.string(), *[pa.int64()] * 4, pa.binary(), pa.bool_()]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                columns[5] = columns[5].view(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _STATEMENT.split(", ")])

    segments = d.mapInArrow(cut, _SEGMENT)
    whole = segments.filter("first and last").select("file", "range", "nth", "begin", "end", "text", "closed")
    parts = segments.filter("not (first and last)")
    sizes = parts.groupBy("file", "begin").agg(F.sum(F.octet_length("text")).alias("size"))
    small = F.when(F.col("size") <= most_bytes, F.col("text"))
    joined = parts.join(sizes, ["file", "begin"]).groupBy("file", "begin").agg(
        F.min_by("range", "at").alias("range"), F.min_by("nth", "at").alias("nth"), F.max("end").alias("end"), F.max_by("closed", "at").alias("closed"), F.max("size").alias("size"), F.array_sort(F.collect_list(F.when(small.isNotNull(), F.struct("at", "text")))).alias("texts")
    )
    text = F.when(F.col("size") <= most_bytes, F.unhex(F.array_join(F.transform("texts", lambda x: F.hex(x["text"])), "")))
    over = joined.select("file", "range", "nth", "begin", "end", text.alias("text"), "closed")
    return whole.unionByName(over).mapInArrow(finish, _STATEMENT)


def numbered(statements: DataFrame) -> DataFrame:
    """(file, pos, start, end, text, closed) of what split_statements gives, with each statement's place in its file, from 0.

    Places are those in the range added to the counts of the ranges before, so no text is shuffled; for the counts the statements are made twice. Store them first if that is dear.
    """
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    counts = stored(statements.groupBy("file", "range").count().select("file", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "dump-counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_RANGES else counts
    return statements.join(counts, ["file", "range"]).select("file", (F.col("before") + F.col("nth")).alias("pos"), "start", "end", "text", "closed")
