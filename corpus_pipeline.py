"""A cleaning pipeline over `documents`: each stage is one of the operators, and its decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  Stages are judged on their own input: models are fitted on the documents a stage gets
and the tables in sf_dir.

Defined results: documents with a null or empty text, or one without a letter, go in the first stage; a document
without an id can't be in a group of near-duplicates and goes on; of rows that share an id one stays, the
one with the least text; columns besides those of documents are carried as they are up to the last stage; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, neardup, packing, pii, toxicity
from tessera.llm.common import cut, documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on; null texts, texts without a letter and ambiguous ones go."""
    return langid.keep_identified(docs, langid.fit(docs))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go."""
    return toxicity.keep_harmless(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    found = cut(neardup.near_duplicates(docs).where("doc_id is not null"))
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone"))
    left = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    repeated = cut(found.where("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id"))
    if not repeated.limit(1).count():
        return left
    # rows that share an id are one document: the one with the least text stays
    once = left.join(repeated, F.col("doc_id") == F.col("__id"), "left_anti")
    least = left.join(repeated, F.col("doc_id") == F.col("__id")).groupBy("__id").agg(F.min_by(F.struct(*[f"`{c}`" for c in docs.columns]), F.struct("text", F.xxhash64(*[f"`{c}`" for c in docs.columns]))).alias("d"))
    return once.union(least.select("d.*"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; n_chars follows the text."""
    out = pii.replace(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids and their places in sequences of 2048 tokens."""
    out = packing.pack(packing.pieces(docs, with_ids=True))
    return out


STAGES = [("language ID", language), ("toxicity", harmless), ("near-duplicates", unique), ("PII", private), ("best-fit packing", packed)]

#: Trained models, keyed surrogates and tokenizers are beyond SQL; tests hold the stages against brute force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
