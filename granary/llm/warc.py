"""WARC archives of pages, and a capture index of two levels: sorted keys in compressed blocks, and a sparse directory of the blocks."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import lookup, small_batches, stored

CRLF = "\r\n"
FILE_BYTES = 16_000_000
BLOCK_LINES = 3000
#: Blocks that one range of an index file holds; ranges without a wanted block are not read.
RANGE_BLOCKS = 1
#: Spans of wanted blocks that the reader is told; where there are more, those with the least blocks between them are read as one.
MOST_SPANS = 512
#: Groups of equal payloads, and index blocks, that are broadcast at most; more of them are joined by shuffling.
BROADCAST_GROUPS, BROADCAST_BLOCKS = 200_000, 500_000
#: What a URL starts with: scheme, user and host; the rest follows.
_URL = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)(.*)", re.S)
_LINE = "key string, page_id long, file string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def surt(url: str | None) -> str:
    """The key of a URL: its host's labels in reverse, lower-cased, then the rest; other strings are their own key, null is the empty one."""
    m = _URL.fullmatch(url or "")
    return ",".join(reversed(m[1].lower().split("."))) + ")" + m[2] if m else url or ""


def _record(page_id: Column, url: Column, payload: Column, digest: Column, size: Column, refers_to: Column) -> Column:
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x.cast("string"), F.lit(CRLF))
    body = F.when(refers_to.isNull(), F.concat(F.lit(http), payload)).otherwise(F.lit(http))
    uri = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(refers_to.isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", urn(page_id)),
        F.lit(f"WARC-Date: 1970-01-01T00:00:00Z{CRLF}"),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("X-Payload-Length", size),
        F.when(refers_to.isNull(), "").otherwise(F.concat(line("WARC-Refers-To", urn(refers_to)), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length(body)),
        F.lit(CRLF),
        body,
    )


def write_archives(pages: DataFrame, folder: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a WARC 1.1 record for each row of pages to files of about FILE_BYTES in folder, by Spark's text writer (records end with two line ends, as the format asks).

    Of records with equal payloads of at least `least` bytes, that with the largest page_id is the response and the others are
    revisits without payload. A null html is an empty payload; a null url gives no target; a null id is written `none` and never referred to.
    Rows that repeat the largest id of a group are responses all. Very long payloads are written whole (readers take files of up to 2 GB, so one
    record has less). An empty table gives empty archives. Other columns of pages are not looked at.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    sizes = stored(p.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")), "payloads")
    total = sizes.agg(F.sum(F.col("size") * F.col("copies")), F.sum("copies")).first()
    per_file = int(max(1, FILE_BYTES // max(1, (total[0] or 0) // max(1, total[1] or 0) + 600)))
    same = stored(sizes.filter((F.col("copies") > 1) & (F.col("size") >= least) & F.col("keeper").isNotNull()).select("digest", "keeper", "copies"), "equal-payloads")
    if same.count() <= BROADCAST_GROUPS:
        p = p.join(F.broadcast(same.drop("copies")), "digest", "left")
    else:
        p = lookup(p, same, "digest", "copies", F.sha1(F.concat_ws(":", F.lit("page"), "page_id").cast("binary")))
    refers = F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    p.select(_record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("size"), refers).alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).text(folder)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, block) of each record; lengths say where records end, so payloads may hold anything."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8").split(CRLF)[1:]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        stop = end + 4 + int(headers["content-length"])
        yield at, stop + 4 - at, headers, data[end + 4 : stop]
        at = stop + 4


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives: key, page_id, file, offset, length, record_type, payload_bytes, payload_digest, refers_to. Payloads are measured and hashed anew; one that differs from its header is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                file, rows = b.column(0)[k].as_py(), []
                for offset, length, h, block in parse(b.column(1)[k].as_py()):
                    size, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response":
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{file}: the record at byte {offset} is damaged")
                    rows.append((surt(h.get("warc-target-uri")), _page(h["warc-record-id"]), file, offset, length, h["warc-type"], size, digest, _page(h.get("warc-refers-to"))))
                if rows:
                    names = [x.split()[0] for x in _LINE.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("key", "file", "record_type", "payload_digest") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(read, _LINE)


def write_index(records: DataFrame, folder: str) -> None:
    """Sorts captures by key over shards and writes blocks of BLOCK_LINES of them: shard, block, first (key), n and data (zlib of JSON lines). A shard is a folder, and its file has ranges of RANGE_BLOCKS blocks whose least and greatest number its footer tells."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        block, held, first = shard << 32, [], ""  # the numbers of two shards differ

        def out() -> pa.RecordBatch:
            data = zlib.compress("\n".join(held).encode())
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([first]), pa.array([len(held)], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "first", "n", "data"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not held:
                    first = row[0]
                held.append(json.dumps(row))
                if len(held) == BLOCK_LINES:
                    yield out()
                    held, block = [], block + 1
        if held:
            yield out()

    blocks = records.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(pack, "shard long, block long, first string, n long, data binary")
    blocks.write.option("parquet.block.row.count.limit", RANGE_BLOCKS).partitionBy("shard").parquet(folder)


def find_captures(wanted: DataFrame, folder: str) -> DataFrame:
    """All captures of the keys in wanted (a column `key`; repeats count once), by the index in folder.

    The directory - first keys of all blocks, one line for BLOCK_LINES captures - is searched by bisection for the blocks that may hold
    a key; of the index files only the ranges with these are read, they are unpacked and searched by bisection again. Keys without a capture give no row. A key with captures in many
    blocks is looked up in each, in different tasks.
    """
    spark = wanted.sparkSession
    index = spark.read.schema("shard long, block long, first string, n long, data binary").parquet(folder)
    keys = wanted.select(F.coalesce("key", F.lit("")).alias("key")).distinct()
    if index.count() <= BROADCAST_BLOCKS:
        directory = sorted((r["first"], r.shard, r.block) for r in index.select("first", "shard", "block").collect())
        shared = spark.sparkContext.broadcast(([d[0] for d in directory], directory))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, entries = shared.value
            for b in batches:
                # UTF-8 order is that of code points, as in Python.
                rows = [(k, *entries[i][1:]) for k in b.column(0).to_pylist() for i in range(max(bisect_left(first, k) - 1, 0), bisect_right(first, k))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "shard", "block"])

        at = keys.mapInArrow(blocks, "key string, shard long, block long")
    else:
        # Too many blocks to send: those of a shard meet the keys of its range.
        ends = index.groupBy("shard").agg(F.min("first").alias("low")).orderBy("low").collect()  # one row a shard
        lows = F.array(*(F.lit(r.low) for r in ends))
        near = keys.withColumn("n", F.size(F.filter(lows, lambda x: x <= F.col("key")))).withColumn("_s", F.explode(F.sequence(F.greatest(F.size(F.filter(lows, lambda x: x < F.col("key"))), F.lit(1)), F.greatest("n", F.lit(1)))))
        near = near.withColumn("shard", F.array(*(F.lit(r.shard) for r in ends))[F.col("_s") - 1]).select("key", "shard")
        after = F.lead("first").over(Window.partitionBy("shard").orderBy("block"))
        at = near.join(index.select("shard", "block", "first").withColumn("after", after), "shard").filter("first <= key and (after is null or after >= key)").select("key", "shard", "block")
    at = stored(at, "wanted-blocks")
    asked = at.groupBy("shard", "block", F.pmod(F.xxhash64("key"), F.lit(8)).alias("part")).agg(F.collect_list("key").alias("keys"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _LINE.split(", ")]
        for b in batches:
            for asked_for, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                own = [x[0] for x in lines]
                rows = [x for k in asked_for for x in lines[bisect_left(own, k) : bisect_right(own, k)]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("key", "file", "record_type", "payload_digest") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    part = index.select("shard", "block", "data").filter(_within(_spans(at)))
    return asked.join(part, ["shard", "block"]).select("keys", "data").mapInArrow(search, _LINE)


def _spans(at: DataFrame) -> list[tuple[int, int, int]]:
    """(shard, first, last) of spans that hold all wanted blocks (shard, block), MOST_SPANS at most but one a shard at least: the widest gaps stay out."""
    blocks = at.select("shard", "block").distinct()
    named = blocks.limit(BROADCAST_BLOCKS + 1).collect()
    if len(named) > BROADCAST_BLOCKS:
        ends = blocks.groupBy("shard").agg(F.min("block").alias("low"), F.max("block").alias("high")).collect()  # one row a shard
        return [tuple(r) for r in ends]
    spans = sorted((r.shard, r.block, r.block) for r in named)
    gaps = sorted((b[1] - a[2], i) for i, (a, b) in enumerate(zip(spans, spans[1:], strict=False)) if a[0] == b[0])
    joined = {i for gap, i in gaps[: max(0, len(spans) - MOST_SPANS)]} | {i for gap, i in gaps if gap == 1}
    out: list[tuple[int, int, int]] = []
    for i, (shard, first, last) in enumerate(spans):
        if i - 1 in joined:
            out[-1] = shard, out[-1][1], last
        else:
            out.append((shard, first, last))
    return out


def _within(spans: list[tuple[int, int, int]]) -> Column:
    """A filter that keeps these spans: folders and ranges of other blocks are not read. Conditions are put together in halves, so that they nest little."""
    if len(spans) > 1:
        return _within(spans[: len(spans) // 2]) | _within(spans[len(spans) // 2 :])
    if not spans:
        return F.lit(False)
    shard, first, last = spans[0]
    return (F.col("shard") == shard) & (F.col("block") >= first) & (F.col("block") <= last)


_RECORD = _LINE + ", headers map<string,string>, payload binary"


def fetch_records(found: DataFrame) -> DataFrame:
    """Captures with `headers` and `payload` (null for revisits) of their records: the byte ranges are read inside tasks, each task by file and offset.

    Files are opened by pyarrow, which reads local and mounted folders, s3, gs and hdfs; `file` is the path that the index has. A capture with a null file or offset gives no row, repeated ones are
    read again; nothing else of a file is read. Records of any length below 2 GB are held one at a time.
    """
    names = [x.split()[0] for x in _LINE.split(", ")]
    kinds = [pa.string() if n in ("key", "file", "record_type", "payload_digest") else pa.int64() for n in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, source = None, None
        for b in batches:
            rows, size = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, _, file, offset, length, kind, *_ = row
                if file != at:
                    if source:
                        source.close()
                    system, path = pa.fs.FileSystem.from_uri(file)
                    at, source = file, system.open_input_file(path)
                source.seek(offset)
                _, _, headers, block = next(parse(source.read(length)))
                rows.append((*row, list(headers.items()), block[block.find(b"\r\n\r\n") + 4 :] if kind == "response" else None))
                size += length
                if size > FILE_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)
        if source:
            source.close()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*kinds, pa.map_(pa.string(), pa.string()), pa.binary()], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "headers", "payload"])

    small_batches(found.sparkSession)
    d = found.filter("file is not null and offset is not null").repartition("file").sortWithinPartitions("file", "offset")
    return d.select(*names).mapInArrow(read, _RECORD)


def read_record(spark: SparkSession, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, by a range read of its bytes alone, on any file system that Hadoop knows."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(length)))
    finally:
        stream.close()
    return next((h, block) for _, _, h, block in parse(data))


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes folder/warc and the index of what stands there, folder/index."""
    write_archives(pages, f"{folder}/warc", id_col=id_col, url_col=url_col, html_col=html_col)
    write_index(captures(pages.sparkSession, f"{folder}/warc"), f"{folder}/index")


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The column `key` of each row's URL, as the archives have it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(None if u is None else u.replace("\r", "%0D").replace("\n", "%0A")) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    return pages.select(url_col).mapInArrow(made, "key string")
