"""Labelled training rows for the two classifiers: a bounded, documented sample that is safe to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_labelled: int) -> DataFrame:
    """doc_id, text (binary), y of at most `max_labelled` labelled documents outside the held-out fold.

    The sample is the labelled ids of smallest hash, so it is the same at each run. Of several labels of an id the largest counts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    own = own.where(fold("doc_id", folds) != held).groupBy("doc_id").agg(F.max("y").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(own), "doc_id")


def scored(docs: DataFrame, folds: int, held: int, score) -> DataFrame:
    """doc_id, held_out, score and predicted for all rows; `score` maps Arrow batches of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return score(rows).withColumn("held_out", F.coalesce(fold("doc_id", folds) == held, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
