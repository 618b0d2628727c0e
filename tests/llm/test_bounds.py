"""Limits of what a task or the driver holds, lowered: results stay the same."""

import random

import pyarrow as pa

from pyspark.sql import functions as F

from granary.llm import decontamination, warc
from granary.llm.common import scratch


def test_decontamination_in_slices_finds_the_same(monkeypatch):
    rnd = random.Random(1)
    words = [f"v{i}" for i in range(60)]
    items = [(i // 2, " ".join(rnd.choice(words) for _ in range(rnd.choice((8, 12, 20, 40, 90, 300))))) for i in range(60)]  # ids come twice
    index = decontamination.build_index(items, 0.2, 0.95)
    texts = [None, ""]
    for _ in range(8):
        out = []
        for _ in range(40):
            copy = rnd.choice(items)[1].split()
            for _ in range(rnd.randint(0, len(copy) // 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out += [rnd.choice(words) for _ in range(30)] + copy
        texts.append(" ".join(out))
    whole = decontamination.search(pa.array(texts), index)
    monkeypatch.setattr(decontamination, "HITS", 60)
    assert len(whole) > 200 and decontamination.search(pa.array(texts), index) == whole


def test_decontamination_of_repetitive_text_is_bounded(monkeypatch):
    monkeypatch.setattr(decontamination, "HITS", 10_000)
    index = decontamination.build_index([(i, "tick tock " * (10 + i % 3) + f"w{i}") for i in range(20)], 0.2, 0.95)
    sizes, likely = [], decontamination._likely
    monkeypatch.setattr(decontamination, "_likely", lambda row, *x: sizes.append(len(row)) or likely(row, *x))
    found = decontamination.search(pa.array(["tick tock " * 20_000]), index)
    assert sorted({f[1] for f in found}) == list(range(20)) and max(sizes) < 30_000


def bytes_read(spark, job):
    """What `job` returns, and the bytes that Spark's tasks read from files for it."""
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getStatistics("file", spark._jvm.org.apache.hadoop.fs.Path("file:///").getFileSystem(spark._jsc.hadoopConfiguration()).getClass())
    before = statistics.getBytesRead()
    out = job()
    return out, statistics.getBytesRead() - before


def test_index_ranges_are_read_and_no_others(spark):
    n = F.col("id").cast("string")
    key = F.concat(F.lit("com,host"), F.lpad((F.col("id") % 5000).cast("string"), 4, "0"), F.lit(")/"), F.sha2(n, 256))
    lines = spark.range(100_000).select(key.alias("key"), F.col("id").alias("page_id"), F.concat(F.lit("file:/archives/"), F.sha2((F.col("id") % 50).cast("string"), 256)).alias("file"), (F.col("id") * 991).alias("offset"), F.lit(990).cast("long").alias("length"), F.lit("response").alias("record_type"), F.lit(900).cast("long").alias("payload_bytes"), F.sha1(n).alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"))
    folder = scratch(spark, "test-index")
    warc.write_index(lines, folder)
    size = sum(f.length for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("length").collect())
    rows = lines.filter("id in (4711, 99999)" if "id" in lines.columns else "page_id in (4711, 99999)").select("key", "page_id").collect()
    for want in (rows[:1], rows):
        keys = spark.createDataFrame([(r.key,) for r in want], "key string")
        found = warc.find_captures(keys, folder)  # this reads the directory
        got, read = bytes_read(spark, found.collect)
        assert {r.page_id for r in got} == {r.page_id for r in want}
        assert read < 0.05 * len(want) * size, (read, size)


def test_many_spans_are_read_as_few(spark, monkeypatch):
    at = spark.createDataFrame([(0, 1), (0, 2), (0, 9), (0, 30), (1, 4), (1, 4), (1, 90)], "shard long, block long")
    assert warc._spans(at) == [(0, 1, 2), (0, 9, 9), (0, 30, 30), (1, 4, 4), (1, 90, 90)]
    for most, spans in ((4, [(0, 1, 9), (0, 30, 30), (1, 4, 4), (1, 90, 90)]), (1, [(0, 1, 30), (1, 4, 90)])):
        monkeypatch.setattr(warc, "MOST_SPANS", most)
        assert warc._spans(at) == spans
    monkeypatch.setattr(warc, "BROADCAST_BLOCKS", 3)
    assert sorted(warc._spans(at)) == [(0, 1, 30), (1, 4, 90)]
    blocks = spark.range(200).select((F.col("id") % 2).alias("shard"), F.col("id").alias("block"))
    assert blocks.filter(warc._within([(0, 3, 9), (1, 5, 5), (1, 100, 120)])).count() == 3 + 1 + 10 and blocks.filter(warc._within([])).isEmpty()
