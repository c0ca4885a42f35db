"""Session folds over event logs in batch (M1, M2); their streams are in boards.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moodboards(events: DataFrame) -> DataFrame:
    """user_id, pos, item of (ts, event_id, user_id, action, item): add if absent, remove if present, clear empties; kept in the order
    of the first add since the item's last removal. Aggregates alone, so a user of any size is no single task's."""
    at = F.struct("ts", "event_id")
    clears = events.where("action = 'clear'").groupBy("user_id").agg(F.max(at).alias("cleared"))
    live = events.where("action in ('add', 'remove')").withColumn("at", at).join(clears, "user_id", "left").where(F.col("cleared").isNull() | (F.col("at") > F.col("cleared")))
    gone = live.where("action = 'remove'").groupBy("user_id", "item").agg(F.max("at").alias("removed"))
    kept = live.where("action = 'add'").join(gone, ["user_id", "item"], "left").where(F.col("removed").isNull() | (F.col("at") > F.col("removed"))).groupBy("user_id", "item").agg(F.min("at").alias("since"))
    return kept.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("since")) - 1).alias("pos"), "item")


def selection(events: DataFrame) -> DataFrame:
    """user_id, item that are selected: the last of an item's own on/off and the user's all_on/all_off counts, for items ever named."""
    at = F.struct("ts", "event_id")
    bulk = events.where("action in ('all_on', 'all_off')").groupBy("user_id").agg(F.max(at).alias("bulk_at"), F.max_by("action", at).alias("bulk"))
    own = events.where("action in ('on', 'off')").groupBy("user_id", "item").agg(F.max(at).alias("own_at"), F.max_by("action", at).alias("own"))
    both = own.join(bulk, "user_id", "left")
    on = F.when(F.col("bulk_at").isNull() | (F.col("own_at") > F.col("bulk_at")), F.col("own") == "on").otherwise(F.col("bulk") == "all_on")
    return both.where(on).select("user_id", "item")
