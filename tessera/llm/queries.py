"""The queries of the operators, as the entry point registers them, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lattice, multiindex, neardup, packing, pii, sharding, tokenfiles, topk, toxicity
from .common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, ~langid.held_out())
    return langid.identify(docs, model).withColumn("held_out", langid.held_out())


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir)))


def op3_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode_samples(documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=4)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir).select("doc_id", "text"))


def op6_histogram_sort_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.histogram_shards(documents(spark, sf_dir), 16, columns=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(documents(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(documents(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"), ~toxicity.held_out("id"))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sampled_segmentations": op3_sampled_segmentations,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_histogram_sort_sharding": op6_histogram_sort_sharding,
    "op7_inverted_multi_index": op7_inverted_multi_index,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_token_id_output": op9_token_id_output,
    "op10_toxicity": op10_toxicity,
}

#: Law: a set is the distinct 4-word shingles; pairs that share a shingle are compared in full.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda w: length(w) > 0) AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM words
), shingle AS (SELECT doc_id, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN sets p ON p.doc_id = u JOIN sets q ON q.doc_id = v WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (SELECT doc_id AS node, doc_id AS least FROM sets UNION SELECT b.v, r.least FROM reach r JOIN both_ways b ON b.u = r.node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.least) AS component_id, s.doc_id = min(r.least) AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.s
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op4_minhash_near_dedup": OP4_SQL, "op8_exact_top_k": OP8_SQL}
