"""Neighbour smoothing of coordinates over a nearest-neighbour graph (C7): message passing as joins, a written table for each round."""

from __future__ import annotations

from prismar.functions.vectors import l2_normalize
from prismar.operators.cluster import layout
from prismar.operators.cuts import cut, discard
from prismar.operators.search import knn_join
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def neighbour_graph(items: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """a, b, weight both ways: 1 for each direction in which one is among the other's k nearest (itself left out)."""
    near = knn_join(items, items.withColumnRenamed("item_id", "query_id"), k, vector, without_self=True).select(F.col("query_id").alias("a"), F.col("item_id").alias("b"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def energy(now: DataFrame, start: DataFrame, graph: DataFrame, alpha: float, axes: tuple[str, ...]) -> float:
    """What smoothing lessens: weighted squares of the edges' lengths, and of the way from where each item began (by its degree, times (1 - alpha) / alpha)."""
    far = lambda p, q: sum((F.pow(F.col(f"{p}.{c}") - F.col(f"{q}.{c}"), 2) for c in axes), F.lit(0.0))
    edges = graph.alias("g").join(now.alias("p"), F.col("g.a") == F.col("p.item_id")).join(now.alias("q"), F.col("g.b") == F.col("q.item_id"))
    inner = edges.agg(F.sum(F.col("g.weight") * far("p", "q") / 2)).first()[0] or 0.0
    degree = graph.groupBy("a").agg(F.sum("weight").alias("d"))
    moved = now.alias("p").join(start.alias("q"), "item_id").join(degree, F.col("item_id") == F.col("a"))
    return inner + (moved.agg(F.sum(F.col("d") * (1 - alpha) / alpha * far("p", "q"))).first()[0] or 0.0)


def smooth(start: DataFrame, graph: DataFrame, alpha: float = 0.5, rounds: int = 20, tolerance: float = 1e-4, trace: list | None = None) -> DataFrame:
    """item_id and coordinates after smoothing `start` (item_id, x, y[, z]) over `graph` (a, b, weight, both ways).

    In a round each item goes to (1 - alpha) of its start and alpha of the weighted mean of its neighbours, which lowers the energy every time; it ends when no item moves by
    more than `tolerance`, `rounds` at most. Messages are summed in the tasks before they meet, so that an item with many neighbours isn't one task's. Items without
    neighbours stay. `trace`: gets the energy before and after each round.
    """
    axes = tuple(c for c in AXES if c in start.columns)
    graph, first = cut(graph, "graph"), cut(start.select("item_id", *(F.col(c).cast("double").alias(c) for c in axes)), "start")
    now = first
    if trace is not None:
        trace.append(energy(now, first, graph, alpha, axes))
    for _ in range(rounds):
        sent = graph.join(now, graph["b"] == now["item_id"]).groupBy("a").agg(F.sum("weight").alias("d"), *(F.sum(F.col(c) * F.col("weight")).alias(f"sum_{c}") for c in axes))
        there = first.join(sent, first["item_id"] == sent["a"], "left")
        new = [F.when(F.col("d") > 0, (1 - alpha) * F.col(c) + alpha * F.col(f"sum_{c}") / F.col("d")).otherwise(F.col(c)).alias(c) for c in axes]
        following = cut(there.select("item_id", *new), "smoothed")
        way = sum((F.pow(following[c] - now[c], 2) for c in axes), F.lit(0.0))
        moved = following.join(now, "item_id").agg(F.max(way)).first()[0]
        if now is not first:
            discard(now)
        now = following
        if trace is not None:
            trace.append(energy(now, first, graph, alpha, axes))
        if moved is None or moved <= tolerance**2:
            break
    return now


def smooth_layout(items: DataFrame, dims: int = 2, k: int = 10, **options) -> DataFrame:
    """The layout of `items` (item_id, embedding), smoothed over their k nearest neighbours."""
    unit = items.where("embedding is not null").select("item_id", l2_normalize("embedding").alias("embedding"))
    return smooth(layout(items, dims), neighbour_graph(unit, k), **options)
