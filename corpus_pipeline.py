"""From documents to a training mix: five stages, each by an operator of granary.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontamination, language_id
from granary.llm.common import fresh, stored, table
from granary.llm.line_dedup import dedup_lines
from granary.llm.mixing import mix
from granary.llm.ngram_join import ngram_components

#: Ids to drop in this number are broadcast; more of them are joined by shuffling.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs but those with one of ids; rows without an id stay."""
    gone = fresh("id", docs)
    ids = stored(ids.select(F.col("doc_id").alias(gone)).distinct(), name)
    ids = ids if ids.count() > BROADCAST_IDS else F.broadcast(ids)
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no letter, or far from every centroid. Null and empty texts have no letter and go; very long texts are judged whole; repeated rows are judged alike, and so are null ids; an empty table stays empty."""
    return language_id.identify(docs, language_id.fit(docs)).filter(~F.col("lang_rejected")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps lines that several documents share only in the first of them; every document stays, with what is left of its text. A null text stays null; rows that repeat an id are one document; lines of rows without an id go where a document with one has them; very long lines count whole; n_chars is counted anew."""
    d = dedup_lines(docs)
    return d.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of the n-gram join connect, the one with the smallest id stays; of rows with one id and text, one. Null and empty texts are linked with nothing and stay, as do rows without an id; documents whose similarity ties stay or go with their group; texts are compared whole; an empty table stays empty."""
    linked = ngram_components(docs)
    d = _without(docs, linked.filter("component_id <> doc_id"), "near-copies")
    again = stored(linked.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return d
    twice = d.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(d, again, "repeated-ids").unionByName(twice)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, whole or with few words changed. Null and empty texts hold nothing and stay, as do rows without an id; rows that repeat an id go together; very long texts are searched whole; an empty benchmark or table drops nothing."""
    return _without(docs, decontamination.leaks(docs, table(spark, sf_dir, "benchmark")), "leaks")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which it takes words, and how many. Null and empty texts have no words and are not in it; null sources are a source; ties of the random keys are settled by id and size; repeated rows count each; an empty table gives an empty mix."""
    return mix(docs).filter("taken > 0")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Nearest centroids can't be expressed in SQL; tests/llm compares the other stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the tables documents and benchmark in sf_dir: every stage but the last is written to the shared folder and read again by the next, so a lost executor repeats one stage at most. Extra columns of documents go through to the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
