"""Queries of this folder's operators over the driver's tables, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, html, language, mixing, nearjoin, quality, substrings, tokens, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    return language.predict(docs, language.learn(docs.where("NOT held_out")), ["doc_id", "held_out"])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"), min_dedupe_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), scale=1.5, cap=2).select("doc_id", "size", "source_size", "target", "taken")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), length=100)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "lang", "n", "perplexity", "keep")


def op9_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_token_ids, op2_fingerprints, op3_language, op4_decontaminate, op5_warc, op6_mix, op7_substrings, op8_quality, op9_near_join, op10_main_text, pipeline]
    return {f.__name__: f for f in every}


OP5 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS runs FROM w),
e AS (SELECT doc_id, unnest(runs) AS r, len(runs) AS n FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.r = b.r AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
  UNION ALL SELECT a.doc_id, b.doc_id FROM s a JOIN s b ON len(a.runs) = 0 AND len(b.runs) = 0 AND a.doc_id <> b.doc_id),
reach AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT reach.doc_id, pairs.y FROM reach JOIN pairs ON reach.seen = pairs.x),
c AS (SELECT doc_id, min(seen) AS class_id FROM reach GROUP BY doc_id),
n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT c.doc_id, c.class_id, coalesce(n.n, 0) AS n_links FROM c LEFT JOIN n ON c.doc_id = n.x
"""

OP7 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS i, h FROM t),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(substr(h, (2 * i + 1)::INT, 200)) ORDER BY doc_id, i) AS k FROM p),
r AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS gap FROM w WHERE k > 1),
g AS (SELECT doc_id, i, sum((gap > 100)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, span),
parts AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM spans GROUP BY doc_id)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda k:
    substr(h, (CASE WHEN k = 1 THEN 1 ELSE 2 * ends[(k - 1)::INT] + 1 END)::INT,
      (2 * (CASE WHEN k = n_spans + 1 THEN length(h) // 2 ELSE starts[k::INT] END - CASE WHEN k = 1 THEN 0 ELSE ends[(k - 1)::INT] END))::INT)), '') END)) AS kept_sha256
FROM t LEFT JOIN parts ON t.doc_id = parts.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": OP5, "op7_substrings": OP7, "op9_near_join": OP9}
