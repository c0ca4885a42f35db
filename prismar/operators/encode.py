"""Encoders: a plug-in model run in Arrow batches, routed by modality, and a hash encoder that needs no weights."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from prismar.functions.vectors import l2_normalize
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = {"image": 32, "audio": 32, "text": 64}


def encode(df: DataFrame, make_predict_fn: Callable, column: str, out: str = "embedding", batch_size: int = 32, shape: list[int] | None = None) -> DataFrame:
    """`make_predict_fn` builds the model once per worker and returns a function from a numpy batch to vectors; `shape` is that of one input
    where the column holds arrays. A row without input has no vector."""
    model = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[shape] if shape else None)
    kind = df.schema[column].dataType
    blank = F.array_repeat(F.lit(0.0).cast(kind.elementType), math.prod(shape)) if shape else F.lit("").cast(kind)
    return df.withColumn(out, F.when(F.col(column).isNotNull(), model(F.coalesce(F.col(column), blank))))


def block_means(side: int = 8, blocks: int = 2) -> Callable:
    """A stand-in for an image tower that needs no weights: the means of blocks x blocks parts of a square image."""
    def make() -> Callable:
        step = side // blocks
        return lambda x: x.astype(float).reshape(len(x), blocks, step, blocks, step).mean(axis=(2, 4)).reshape(len(x), -1).astype(np.float32)

    return make


def letter_counts(letters: str) -> Callable:
    """A stand-in for a text tower: how often each letter is there."""
    def make() -> Callable:
        return lambda texts: np.array([[t.count(c) for c in letters] for t in texts], np.float32)

    return make


def extremes() -> Callable:
    """A stand-in for an audio tower: the least and the largest sample."""
    def make() -> Callable:
        return lambda x: np.stack([x.min(axis=1), x.max(axis=1)], axis=1).astype(np.float32)

    return make


def encode_by_modality(df: DataFrame, encoders: dict[str, Callable], column: str, shape: list[int] | None = None) -> DataFrame:
    """Each row by the encoder of its modality; a modality without one fails the job."""
    unknown = F.raise_error(F.concat(F.lit("unknown modality: "), F.coalesce("modality", F.lit("null")))).cast("string")
    checked = df.withColumn("modality", F.when(F.col("modality").isin(*encoders), F.col("modality")).otherwise(unknown))
    parts = [encode(checked.where(F.col("modality") == m), f, column, batch_size=BATCH.get(m, 32), shape=shape) for m, f in encoders.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hash_encode(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """key, embedding: each token adds +1 or -1 at a hashed place. Sums are partial before the one shuffle by key."""
    tokens = df.select(key, F.explode(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")).alias("t"))
    h = F.xxhash64("t")
    sums = tokens.groupBy(key, F.pmod(h, F.lit(dims)).cast("int").alias("i")).agg(F.sum(F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("x"))
    arrays = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    full = lambda m: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)).cast("float"))
    return df.select(key).join(arrays, key, "left").select(key, full("m").alias("embedding"))


def label_matrix(labels: DataFrame, built: DataFrame | None = None) -> DataFrame:
    """label, content_md5, embedding (unit length) of labels not yet in `built`."""
    keyed = labels.select("label", F.md5("label").alias("content_md5")).dropDuplicates(["content_md5"])
    keyed = keyed if built is None else keyed.join(built.select("content_md5"), "content_md5", "left_anti")
    vectors = hash_encode(keyed, "label", "label")
    return keyed.join(vectors, "label").withColumn("embedding", l2_normalize("embedding"))
