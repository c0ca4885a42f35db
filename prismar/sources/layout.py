"""Tables bucketed by item id, so that joins on it need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 32


def write_bucketed(rows: DataFrame, name: str, buckets: int = BUCKETS, key: str = "item_id", path: str | None = None) -> DataFrame:
    """Write `rows` as the catalogue's table `name`, its files bucketed and sorted by `key`; each bucket is written by one task. Tables of equal bucket numbers join bucket by bucket."""
    writer = rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


def bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
