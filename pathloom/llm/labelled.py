"""Bounded samples of labelled rows and small shared parts of the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model may be fitted on (those with the least hash of doc_id).
LABELLED_ROWS = 12_000


def held_out(doc_id):
    """Rows whose labels are never learnt: crc32 of doc_id as text, modulo 4, is 2. A null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def all_training_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label of all labelled rows that are not held out; a doc_id with several labels has the largest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    return known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def training_labels(labels: DataFrame, column: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """At most `rows` of all_training_labels."""
    return all_training_labels(labels, column).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def auc(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.bincount(inverse, rank) / counts)[inverse]
    pos = label == 1
    n1, n0 = pos.sum(), (~pos).sum()
    return float((rank[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")
