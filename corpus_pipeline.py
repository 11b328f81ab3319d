"""A training corpus from documents in five stages. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each one's result as Parquet to the shared folder and gives it to the next."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm import bpe, decontam, langid, minhash, secrets
from registrum.llm._shared import bounded, scratch, small_batches, staged, table, unused

#: A document stays if this share of its letters is in one language that the model knows.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, without text, or without one language that most letters are in, go. A null lang is filled in. Rows are
    judged one by one: repeated rows and null ids stay as they are. An empty table, or one without labels, gives an empty table."""
    small_batches(spark)
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    told = langid.labelled(docs, langid.learn(docs), lang=lang, score=score)
    good = told.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SHARE))
    return good.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal and near-equal documents the one row with the least doc_id (null last) stays. Null texts stay; empty texts
    are equal to each other; an empty table stays empty."""
    small_batches(spark)
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, told by doc_id and text, so that a clean row that shares the id of another stays.
    Null and empty texts have no words and stay; repeated rows go or stay together; with an empty benchmark or no documents none goes."""
    small_batches(spark)
    its_id, its_key = unused(docs, "its_id"), unused(docs, "its_key")
    with scratch(spark) as keep:
        found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
        leaks = keep(staged(found.where("contaminated").select(F.col("doc_id").alias(its_id), F.col("text_key").alias(its_key)).distinct(), "leaks"))
    same = F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.xxhash64("text") == F.col(its_key))
    return docs.join(bounded(leaks), same, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are marked out of the texts, whose n_chars then follow; every row stays, null and empty texts as they are."""
    small_batches(spark)
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row that is left; a null text is encoded as an empty one."""
    small_batches(spark)
    return bpe.bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("bpe", encode)]

#: Sketches and dynamic programs are beyond SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(staged(stage(spark, docs, sf_dir), f"stage-{name}"))
    return docs
