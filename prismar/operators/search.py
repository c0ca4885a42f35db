"""Similarity search, top-k, fusion and result shaping over DataFrames of items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from prismar.functions.vectors import minmax_normalize
from prismar.operators.cuts import cut
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WEIGHTS = {"histogram": 0.4, "edge": 0.3, "lbp": 0.3}
BROADCAST_BYTES = 64 << 20
CELLS = 1 << 22  # similarities held at a time by a task


def top_k(items: DataFrame, query: DataFrame, k: int, vector: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """item_id, distance, rank and the columns in `carry`: the k items nearest to one query row by cosine distance, ties to the smaller id.

    The one query vector is broadcast (a row) with its length, so that the items are scanned once in the same job and each task keeps k rows.
    """
    total = lambda x: f"aggregate({x}, 0D, (s, x) -> s + x)"
    length = lambda v: f"sqrt({total(f'transform({v}, x -> x * x)')})"
    as_double = f"CAST(`{vector}` AS ARRAY<DOUBLE>)"
    wanted = F.broadcast(query.limit(1).select(F.expr(as_double).alias("__q"), F.expr(length(as_double)).alias("__n")))
    own, dot = length(as_double), total(f"zip_with({as_double}, __q, (x, y) -> x * y)")
    distance = F.expr(f"round(1 - CASE WHEN {own} * __n > 0 THEN {dot} / ({own} * __n) ELSE 0D END, 9)")
    best = items.crossJoin(wanted).select("item_id", distance.alias("distance"), *carry).orderBy("distance", "item_id").limit(k)
    return best.select("item_id", "distance", F.row_number().over(Window.orderBy("distance", "item_id")).alias("rank"), *carry)


def by_blocks(queries: DataFrame, key: str, work: Callable[[pa.Table], tuple[Broadcast, DataFrame]], block_rows: int | None = None) -> DataFrame:
    """The union of `work` over blocks of `queries`, each of BROADCAST_BYTES or less.

    `work` gets a block as an Arrow table and returns the broadcast that it made and the rows found with it. Where one block isn't enough, the
    rows of each are written and its broadcast is dropped before the next, so that the driver and the tasks hold one at a time.
    """
    wide = [f.name for f in queries.schema.fields if f.dataType.typeName() == "array"]
    size = sum((F.coalesce(F.size(c), F.lit(0)) for c in wide), F.lit(1))
    n, longest = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(size), F.lit(1))).first()
    rows = block_rows or max(1, BROADCAST_BYTES // (8 * longest))
    blocks = max(1, -(-n // rows))
    found = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        shared, part = work(own.toArrow())
        if blocks > 1:
            part = cut(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def matrix(column: pa.Array | pa.ChunkedArray, unit: bool = True) -> np.ndarray:
    """Rows of a list column of equal lengths as doubles, at unit length (zero vectors stay); without rows, without columns."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    if unit and x.size:
        n = np.sqrt((x * x).sum(axis=1))
        x = x / np.where(n > 0, n, 1)[:, None]
    return x


def knn_join(items: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", block_rows: int | None = None, cells: int = CELLS, without_self: bool = False) -> DataFrame:
    """query_id, rank, item_id, distance: k nearest items of every query row. Null vectors take no part; `without_self`: nor does the item of the query's own id.

    Query blocks are multiplied with the items where these lie, in tiles of at most `cells` distances; a task keeps the k best of each query over all its
    items, and only these are shuffled.
    """
    some = items.where(F.col(vector).isNotNull()).select("item_id", F.col(vector).cast("array<double>").alias("v"))

    def work(block: pa.Table) -> tuple[Broadcast, DataFrame]:
        shared = items.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy(), matrix(block.column("v"))))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            kth, best = np.full(len(ids), np.inf), None
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own, x = batch.column("item_id").to_numpy(), matrix(batch.column("v"))
                order = np.argsort(own, kind="stable")
                own, x = own[order], x[order].T
                step, found = max(1, cells // len(own)), [best] if best else []
                for at in range(0, len(ids), step):
                    d = np.round(1 - q[at : at + step] @ x, 9)
                    if without_self:
                        d[ids[at : at + step, None] == own] = np.inf
                    row, column = np.nonzero(least(d, k) & (d <= kth[at : at + step, None]) & (d < np.inf))
                    found.append((at + row, d[row, column], own[column]))
                best = k_least(*(np.concatenate(c) for c in zip(*found)), k)
                full = np.flatnonzero(np.diff(best[0], append=-1) != 0)
                full = full[np.diff(full, prepend=-1) == k]
                kth[best[0][full]] = best[1][full]
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[2]), pa.array(best[1])], ["query_id", "item_id", "distance"])

        return shared, some.mapInArrow(search, "query_id long, item_id long, distance double")

    mine = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    w = Window.partitionBy("query_id").orderBy("distance", "item_id")
    found = by_blocks(mine, "query_id", work, block_rows)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "item_id", "distance")


def k_least(row: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each row by distance and id, rows in order."""
    order = np.lexsort((ids, d, row))
    row, d, ids = row[order], d[order], ids[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1) != 0)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row)))
    return row[place < k], d[place < k], ids[place < k]


def least(d: np.ndarray, k: int) -> np.ndarray:
    """Marks the k least of each row, ties to the left."""
    if d.shape[1] <= k:
        return np.ones(d.shape, bool)
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    below, ties = d < kth, d == kth
    return below | (ties & (np.cumsum(ties, axis=1) <= k - below.sum(axis=1, keepdims=True)))


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does it, halves away from zero."""
    return np.copysign(np.floor(np.abs(x * 10**digits) + 0.5), x) / 10**digits + 0.0


def fused_search(items: DataFrame, queries: DataFrame, weights: dict[str, float], k: int, fusion: str = "minmax", block_rows: int | None = None, cells: int = CELLS, without_self: bool = False) -> DataFrame:
    """query_id, item_id, score, rank: the k items of largest weighted sum of cosines, one method to each feature column.

    What `score_search`, `fuse` and `best` give by way of a row for each pair, without these rows: all methods are scored in one Arrow pass over the
    items; `minmax` takes a pass before for each method's extremes, which tasks send once a batch. A feature that an item or a query
    lacks adds nothing. Sums are rounded to 6 places before they are ranked. `without_self`: the item of a query's own id isn't ranked (it does count for the extremes).
    """
    total = sum(weights.values()) or 1.0
    methods = {m: w / total for m, w in weights.items() if w and m in items.columns}
    as_list = lambda m: F.col(m).cast("array<double>").alias(m)
    some = items.select(F.col("item_id").cast("long").alias("item_id"), *(as_list(m) for m in methods))
    spark = items.sparkSession

    def sides(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
        return have, matrix(column.drop_null())

    def work(block: pa.Table) -> tuple[Broadcast, DataFrame]:
        ids = block.column("query_id").to_numpy()
        own = {m: sides(block.column(m).combine_chunks(), len(ids)) for m in methods}
        shared = spark.sparkContext.broadcast((ids, own))

        def tiles(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
            for m in methods:
                (who, q), (have, x) = shared.value[1][m], sides(batch.column(m), batch.num_rows)
                step = max(1, cells // max(1, len(have)))
                for at in range(0, len(who) if len(have) else 0, step):
                    yield m, who[at : at + step], have, np.round(q[at : at + step] @ x.T, 9)

        def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for m, who, _, s in tiles(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array([m] * len(who)), pa.array(s.min(axis=1)), pa.array(s.max(axis=1))], ["q", "method", "low", "high"])

        low, span = {m: np.zeros(len(ids)) for m in methods}, {m: np.ones(len(ids)) for m in methods}
        if fusion == "minmax":
            ends = some.mapInArrow(extremes, "q long, method string, low double, high double").groupBy("q", "method").agg(F.min("low"), F.max("high"))
            for q, m, a, b in ends.collect():  # a row for each query of the block and method
                low[m][q], span[m][q] = a, (b - a) if b > a else 1.0
        scale = spark.sparkContext.broadcast((low, span))

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, (low, span) = shared.value[0], scale.value
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                batch = batch.sort_by("item_id")
                item = batch.column("item_id").to_numpy()
                step = max(1, cells // len(item))
                for at in range(0, len(names), step):
                    score, any_of = np.zeros((min(step, len(names) - at), len(item))), np.zeros((min(step, len(names) - at), len(item)), bool)
                    for m, share in methods.items():
                        (who, q), (have, x) = shared.value[1][m], sides(batch.column(m), batch.num_rows)
                        mine = (who >= at) & (who < at + step)
                        if mine.any() and len(have):
                            place = np.ix_(who[mine] - at, have)
                            score[place] += share * (np.round(q[mine] @ x.T, 9) - low[m][who[mine], None]) / span[m][who[mine], None]
                            any_of[place] = True
                    if without_self:
                        any_of &= names[at : at + step, None] != item
                    score = half_up(score, 6)
                    row, column = np.nonzero(least(np.where(any_of, -score, np.inf), k) & any_of)
                    yield pa.RecordBatch.from_arrays([pa.array(names[at + row]), pa.array(item[column]), pa.array(score[row, column])], ["query_id", "item_id", "score"])

        return shared, some.mapInArrow(rank, "query_id long, item_id long, score double")

    mine = queries.select(F.col("query_id").cast("long").alias("query_id"), *(as_list(m) for m in methods))
    return best(by_blocks(mine, "query_id", work, block_rows), k, "query_id")


def pair_scores(items: DataFrame, queries: DataFrame, vector: str, block_rows: int | None = None, cells: int = 1 << 18) -> DataFrame:
    """query_id, item_id, score: the cosine, in 9 places, of every query with every item. Null vectors take no part.

    As in `knn_join`, query blocks are multiplied with the items where these lie; a batch of rows is one tile of at most `cells` pairs (a row of items at least).
    """
    as_list = F.col(vector).cast("array<double>").alias("v")
    some = items.where(F.col(vector).isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), as_list)

    def work(block: pa.Table) -> tuple[Broadcast, DataFrame]:
        shared = items.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy(), matrix(block.column("v"))))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own, x = batch.column("item_id").to_numpy(), matrix(batch.column("v")).T
                step = max(1, cells // len(own))
                for at in range(0, len(ids), step):
                    some_ids = ids[at : at + step]
                    s = half_up(q[at : at + step] @ x, 9)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some_ids, len(own))), pa.array(np.tile(own, len(some_ids))), pa.array(s.ravel())], ["query_id", "item_id", "score"])

        return shared, some.mapInArrow(score, "query_id long, item_id long, score double")

    mine = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), as_list)
    return by_blocks(mine, "query_id", work, block_rows)


def score_search(items: DataFrame, query: DataFrame, feature: str, similarity, method: str) -> DataFrame:
    """query_id, item_id, method, score of all candidates that have the feature."""
    q = F.broadcast(query.limit(1).select("query_id", F.col(feature).alias("__q")))
    return items.where(F.col(feature).isNotNull()).crossJoin(q).where(F.col("__q").isNotNull()).select("query_id", "item_id", F.lit(method).alias("method"), similarity(F.col(feature), F.col("__q")).alias("score"))


def best(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each group, higher first, ties to the smaller id, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "item_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(scores: DataFrame, weights: dict[str, float] | None = None, fusion: str = "minmax") -> DataFrame:
    """query_id, item_id, score: weighted sum over methods. Weights are scaled to 1 and those of 0 skipped; unknown methods have no
    rows and add nothing, without a rescaling; `minmax` normalises each method first, `raw` doesn't."""
    given = weights or DEFAULT_WEIGHTS
    total = sum(given.values()) or 1.0
    share = {m: w / total for m, w in given.items() if w}
    weight = F.create_map(*[x for m, w in share.items() for x in (F.lit(m), F.lit(float(w)))]) if share else F.create_map().cast("map<string,double>")
    own = scores.where(F.col("method").isin(*share))
    own = minmax_normalize(own, "query_id", "method") if fusion == "minmax" else own
    return own.groupBy("query_id", "item_id").agg(F.sum(F.col("score") * F.element_at(weight, F.col("method"))).alias("score"))


def prompt_filter(scores: DataFrame, prompt_hits: DataFrame) -> DataFrame:
    """Keep the items among the prompt's hits; the join decides by itself whether these are small enough to broadcast."""
    return scores.join(prompt_hits.select("item_id"), "item_id", "left_semi")


def with_fallback_method(items: DataFrame, queries: DataFrame, fallback: str, k: int | None = None) -> DataFrame:
    """query_id, rank, item_id, score, method_used: each query's items (the k best, or all without a k) by the method that it wants (column `wanted`, one of the
    feature columns), or by `fallback` where the items have no such feature. Which one is known before anything is scored, so that a query is scored once."""
    out = None
    for wanted in [r.wanted for r in queries.select("wanted").distinct().orderBy("wanted").collect()] or [fallback]:  # method names
        used = wanted if wanted in items.columns else fallback
        own = queries.where(F.col("wanted").eqNullSafe(wanted)).select("query_id", used)
        if k is None:
            w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
            part = pair_scores(items, own, used).withColumn("rank", F.row_number().over(w))
        else:
            part = knn_join(items.select("item_id", used), own, k, used).withColumn("score", F.round(1 - F.col("distance"), 9) + 0.0)
        part = part.select("query_id", "rank", "item_id", "score", F.lit(used).alias("method_used"))
        out = part if out is None else out.unionByName(part)
    return out


def display_rank(groups: DataFrame) -> DataFrame:
    """One row per twin group (query_id, gid, pos, item_id, score): its running number, its first member's score, how many it has."""
    heads = groups.groupBy("query_id", "gid").agg(F.min_by("item_id", "pos").alias("item_id"), F.min_by("score", "pos").alias("score"), F.count(F.lit(1)).alias("members"), F.min("rank").alias("__r"))
    return heads.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("__r"))).drop("__r")


def with_fallback(wanted: DataFrame, stored: DataFrame, key: str, feature: str, computed: Column) -> DataFrame:
    """The stored feature of each wanted row, or the computed one where none is stored."""
    return wanted.join(stored.select(key, F.col(feature).alias("__stored")), key, "left").withColumn("from_store", F.col("__stored").isNotNull()).withColumn(feature, F.coalesce(F.col("__stored"), computed)).drop("__stored")


def path_legs(at: DataFrame) -> DataFrame:
    """`at` (scene, x, y, ...) with the length of the leg from the scene before, null at the first. Scenes are numbered without gaps, so a
    join with the number before does what an ordered window would do in one task."""
    before = at.select((F.col("scene") + 1).alias("scene"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    leg = F.sqrt(F.pow(F.col("x") - F.col("__x"), 2) + F.pow(F.col("y") - F.col("__y"), 2))
    return at.join(before, "scene", "left").withColumn("leg", leg).drop("__x", "__y")
