"""Streams whose batches are each committed under their own id, so that a replayed batch replaces what it wrote (X1 and the session streams)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: on disk, with the changes of each batch in the checkpoint."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def commit(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there to target/batch=<id>, a folder for each batch that the batch overwrites when it is run again."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    with rocksdb(stream.sparkSession):
        return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, *keys: str) -> DataFrame:
    """The last committed row of each key."""
    rows = spark.read.option("basePath", target).parquet(target)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")


def ingest(stream: DataFrame, target: str, model_id: str, encode: Callable[[DataFrame], DataFrame], checkpoint: str, content: str = "content") -> StreamingQuery:
    """New rows of a stream (X1), encoded, each content once for a model.

    `encode` maps rows without an exchange and keeps content_md5 and model_id. What has been ingested is known by hash from the stream's own state (RocksDB), which is
    looked up by key: the target is never read, and contents aren't shuffled, only what they are encoded to.
    """
    hashed = stream.withColumn("content_md5", F.md5(content)).withColumn("model_id", F.lit(model_id))
    return commit(encode(hashed).drop(content).dropDuplicates(["content_md5", "model_id"]), target, checkpoint)
