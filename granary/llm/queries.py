"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontamination, fill_in_middle, html_text, language_id, multiset_hash, periodic_runs, pii, quality, toxicity, warc
from granary.llm.common import id_crc, scratch, table
from granary.llm.line_dedup import dedup_lines
from granary.llm.mixing import mix
from granary.llm.ngram_join import ngram_components


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_crc(F.col("doc_id")) % 5 == 0
    model = toxicity.fit(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    d = toxicity.score(docs.select("doc_id", "text"), model)
    return d.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").cast("long").alias("n_toxic_sentences"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), scratch(spark, "archives")
    warc.archive(pages, folder)
    found = warc.fetch_records(warc.find_captures(warc.keys_of(pages), f"{folder}/index"))
    # Of responses what was read counts, of revisits what their headers say.
    size = F.when(F.col("record_type") == "revisit", F.col("headers")["x-payload-length"].cast("long")).otherwise(F.length("payload").cast("long"))
    digest = F.when(F.col("record_type") == "revisit", F.replace(F.col("headers")["warc-payload-digest"], F.lit("sha1:"), F.lit(""))).otherwise(F.sha1("payload"))
    return found.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), drop_text=True)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "n_tokens", "chars_per_token", "byte_share", "token_entropy")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = pii.find(docs, pii.fit(docs))
    counts = [pii.count_of(F.col("pii_base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return d.select("doc_id", *counts, F.sha2(pii.as_text(F.col("pii_base")), 256).alias("base_sha256"), pii.as_text(F.col("pii_spans")).alias("spans"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_crc(F.col("doc_id")) % 4 == 2
    d = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs.filter(~held_out)))
    return d.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = periodic_runs.find_runs(periodic_runs.planted(docs)).withColumn("best", periodic_runs.best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    ratio = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", ratio, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op12_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = multiset_hash.against_next(table(spark, sf_dir, "documents"))
    prints = [F.base64(c).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return d.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c, name: F.sha2(c, 256).alias(name)
    return d.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), digest("fim_text", "output_sha256"), digest("restored_text", "restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_warc_index, op3_decontamination, op4_line_dedup, op5_quality_fertility, op6_pii, op7_html_main_text, op8_language_id, op9_mixing, op10_ngram_join, op11_periodic_runs, op12_multiset_fingerprints, op13_fill_in_middle)}

WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op2_warc_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS top
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q""",
    "op4_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, {WHITE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
seen AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.doc_id, k.pos, k.line, seen.keeper IS NOT NULL AND seen.keeper <> k.doc_id AS gone FROM k LEFT JOIN seen ON k.key = seen.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM s0),
s2 AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / w AS lim FROM s1),
s3 AS (
  SELECT *, row_number() OVER o AS r,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM s2 WINDOW o AS (ORDER BY lim, source NULLS LAST)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * coalesce((SELECT arg_min(level, r) FROM s3 WHERE level <= lim), (SELECT max(lim) FROM s3))) AS target FROM s3),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken FROM e""",
    "op10_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id""",
    "op11_periodic_runs": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM documents),
h AS (SELECT doc_id, ws, len(ws) AS n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM d),
g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (
  SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[1 + a + (i - a) % p] ELSE ws[1 + i] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
x AS (SELECT doc_id, n, i, lag(word) OVER o AS prev, md5(string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS gram, lead(word, 16) OVER o AS next FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT * FROM x WHERE i + 16 <= n QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
pairs AS (
  SELECT l.doc_id, l.i, r.i - l.i AS q, l.prev IS NULL OR l.prev <> r.prev AS first, r.next IS NULL OR l.next <> r.next AS last
  FROM y l JOIN y r ON l.doc_id = r.doc_id AND l.gram = r.gram AND l.i < r.i AND 3 * (r.i - l.i) <= l.n AND (l.prev IS NULL OR l.prev <> r.prev OR r.next IS NULL OR l.next <> r.next)),
lefts AS (SELECT doc_id, q, i, row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs WHERE first),
rights AS (SELECT doc_id, q, i, row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs WHERE last),
long AS (SELECT l.doc_id, l.i AS start, r.i - l.i + 16 + l.q AS length, l.q AS period FROM lefts l JOIN rights r USING (doc_id, q, k) WHERE r.i - l.i + 16 + l.q >= greatest(24, 3 * l.q)),
runs AS (SELECT * FROM long a WHERE NOT EXISTS (FROM long b WHERE a.doc_id = b.doc_id AND b.period < a.period AND b.start <= a.start AND b.start + b.length >= a.start + a.length)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM w WHERE NOT EXISTS (FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS ts, sha256('1:' || doc_id) AS h FROM documents),
c AS (
  SELECT doc_id, text, ts, CAST(len(ts) AS BIGINT) AS n, least(CAST('0x' || h[1:8] AS BIGINT) % (len(ts) + 1), CAST('0x' || h[9:16] AS BIGINT) % (len(ts) + 1)) AS a,
    greatest(CAST('0x' || h[1:8] AS BIGINT) % (len(ts) + 1), CAST('0x' || h[9:16] AS BIGINT) % (len(ts) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (SELECT *, array_to_string(ts[1:a], '') AS pre, array_to_string(ts[a + 1:b], '') AS mid, array_to_string(ts[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
}
