"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Defined results, in every stage: a null text stays null (packing reads it as empty), and so does a null doc_id; columns
beyond text, whatever their names, pass unchanged, but for n_chars, which follows a changed text; empty documents give
an empty result with the same columns. Without labels of both kinds the toxicity grammar keeps to its fixed words.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import packing, secrets, simhash, suffix_dedup, toxicity
from pathloom.llm._common import ensure_checkpoint_dir, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects (a score of 0.3 or more) go; repeated rows and equal texts go or stay together, null and empty texts stay."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id (a null one comes last); of repeated rows one. Empty and null texts are one group."""
    return simhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts, whole characters only; every document stays, a text may become empty."""
    return _counted(suffix_dedup.remove_repeats(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked; every document stays. Equal texts are masked alike."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a document without a token has its end id. Columns are those of the packing."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", drop_repeats), ("secrets", mask_secrets), ("packing", pack)]
#: SQL cannot express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between them lies in the session's shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
