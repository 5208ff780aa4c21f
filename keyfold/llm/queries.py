"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from keyfold.llm import bpe, decontaminate, knn, license_scan, line_dedup, pii, rollup, secret_scan, simhash, toxicity
from keyfold.llm.shared import shared_dir, written

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under two tokenizer versions; those labelled of low quality are deleted; toxic ones are redacted, which revises their counts to zero; one batch is sent twice."""
    counts = written(rollup.counted(_table(spark, sf_dir, "documents")), "counts")
    labels = _table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = counts.join(labels.filter("quality = 0 OR toxic = 1"), "id")
    low = rollup.by_version(marked.filter("quality = 0"))
    toxic = rollup.by_version(marked.filter("quality <> 0 OR quality IS NULL")).withColumn("new_tokens", F.lit(0))
    table = rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    every = rollup.inserted(rollup.by_version(counts))
    table.commit("1", every.filter("version = 'words-1'"))
    table.commit("2", every.filter("version = 'wordpunct-1'"))
    table.compact()
    table.commit("2", every.filter("version = 'wordpunct-1'"))
    table.commit("3", rollup.deleted(low))
    table.commit("4", rollup.revised(toxic))
    table.commit("3", rollup.deleted(low))
    return table.totals()


OP3_SQL = """
WITH n AS (
  SELECT doc_id, source, lang,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS w,
    (len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> ''))
      + len(regexp_extract_all(coalesce(text, ''), '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]')))::BIGINT AS p
  FROM documents),
l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
kept AS (
  SELECT source, lang, CASE WHEN toxic = 1 THEN 0 ELSE w END AS w, CASE WHEN toxic = 1 THEN 0 ELSE p END AS p
  FROM n LEFT JOIN l USING (doc_id) WHERE quality IS NULL OR quality <> 0),
versions AS (SELECT source, lang, 'words-1' AS version, w AS n FROM kept UNION ALL SELECT source, lang, 'wordpunct-1', p FROM kept)
SELECT source, lang, version, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM versions GROUP BY ALL
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, budget=2)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_pages(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP7_SQL = """
WITH raw AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '') AS host,
    list_filter(list_transform(regexp_split_to_array(
      regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', chr(10), 'g'),
      '(?:<[^>]*>|\n)+'), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160))), lambda x: x <> '') AS lines
  FROM pages),
p AS (SELECT row_number() OVER () AS row_id, * FROM raw),
hosts AS (SELECT host, count(*) AS pages FROM p WHERE host <> '' GROUP BY host),
shares AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT DISTINCT row_id, host, unnest(lines) AS line FROM p WHERE host <> '') GROUP BY host, line),
common AS (SELECT host, line FROM shares JOIN hosts USING (host) WHERE n >= 3 AND n > 0.1 * pages),
kept AS (
  SELECT l.row_id, l.i, l.line FROM (SELECT row_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM p) l
  LEFT JOIN common c ON c.host = l.host AND c.line = l.line WHERE c.line IS NULL),
texts AS (SELECT row_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM kept GROUP BY row_id)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped,
  length(coalesce(text, ''))::BIGINT AS n_chars, sha256(coalesce(text, '')) AS text_sha256
FROM p LEFT JOIN texts USING (row_id)
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), bpe.public_vocabulary, remembered=400_000)


#: Key of the registered query; a real run passes its own secret.
PII_KEY = "registered-query"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(_table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("text", 256).alias("text_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP10_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT row_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT row_id, p.n, i, item_id FROM places p JOIN wins USING (n, win)),
hit AS (SELECT row_id, count(*) AS n_hit FROM (SELECT DISTINCT row_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY row_id),
items AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM found) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (row_id) LEFT JOIN items USING (row_id)
"""


def queries():
    own = (op1_knn, op2_secret_scan, op3_token_rollup, op4_license_scan, op5_toxicity, op6_simhash, op7_line_dedup, op8_bpe, op9_pii, op10_decontaminate)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op1_knn": OP1_SQL, "op3_token_rollup": OP3_SQL, "op7_line_dedup": OP7_SQL, "op10_decontaminate": OP10_SQL}
