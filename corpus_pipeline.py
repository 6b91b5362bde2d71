"""A corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, pii, toxicity
from tessera.llm.common import shared_dir

#: No SQL can express the stages (learned models, tokenizer merges); tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. Null and empty texts are scored as empty ones; repeated
    rows and texts get one score, so they stay or go together; an empty table stays empty."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id. Of rows that
    repeat that id and text one stays; of different texts under it, the one with the least key. Documents without
    words (null, empty) have no copies and all stay."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks, in any case of letters. Rows with a null id or text stay; rows
    that repeat an id go together if any of them leaks."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), folded=True)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by placeholders and n_chars counted anew. Null texts stay
    null, with a null n_chars; repeated rows stay."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of each text, and what they decode to; nulls and empty texts have no ids."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text")).withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_leaks), ("personal data", mask_personal_data), ("bpe", encode_texts)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder, read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
