"""Clustering of unit vectors, choice of k, cluster naming, projection and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from prismar.functions.vectors import cosine_similarity, euclidean_distance, l2_normalize
from prismar.operators import rangefinder
from prismar.operators.cuts import cut
from prismar.operators.search import knn_join, matrix
from prismar.sources.media import FeatureAbsent
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SAMPLE = 5000


def kmeans(items: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """item_id, cluster_id on unit vectors; everything is cluster 0 where there are fewer than k items, k < 2, or the fit can't be made: a vector is missing, has a
    component that isn't a finite number, or is of another length than the rest."""
    v = F.col("embedding").cast("array<double>")
    broken = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    n, low, high, bad = items.agg(F.count(F.lit(1)), F.min(F.size(v)), F.max(F.size(v)), F.max(broken)).first()
    if k < 2 or n < k or low != high or bad:
        return items.select("item_id", F.lit(0).alias("cluster_id"))
    unit = items.select("item_id", array_to_vector(l2_normalize("embedding")).alias("features"))
    return KMeans(k=k, seed=seed).fit(unit).transform(unit).select("item_id", F.col("prediction").alias("cluster_id"))


def centroids(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """cluster_id, centroid: the mean of each place."""
    long = rows.select("cluster_id", F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = long.groupBy("cluster_id", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("centroid"))


def silhouette(rows: DataFrame, sample_size: int = SAMPLE) -> DataFrame:
    """score: mean Euclidean silhouette of at most `sample_size` rows (item_id, cluster_id, embedding). A point alone in its cluster counts 0.

    The sample, which is what the metric is defined on, is broadcast; each row's distances to it are summed by cluster where the row lies.
    """
    some = sample(rows.select(F.col("item_id").cast("long").alias("item_id"), F.col("cluster_id").cast("long").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("v")), sample_size)
    all_rows = some.toArrow()
    names, own = np.unique(all_rows.column("cluster_id").to_numpy(), return_inverse=True)
    shared = rows.sparkSession.sparkContext.broadcast((matrix(all_rows.column("v"), unit=False), own, names, np.bincount(own, minlength=len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own, names, sizes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            y, mine = matrix(batch.column("v"), unit=False), np.searchsorted(names, batch.column("cluster_id").to_numpy())
            out = []
            for at in range(0, len(y), 64):
                d = np.sqrt(((y[at : at + 64, None] - x[None]) ** 2).sum(axis=2))
                sums = np.stack([np.bincount(own, weights=row, minlength=len(names)) for row in d])
                inside = np.eye(len(names), dtype=bool)[mine[at : at + 64]]
                mean = sums / np.maximum(sizes - inside, 1)
                near, next_ = mean[inside], np.where(inside, np.inf, mean).min(axis=1)
                alone = (sizes[mine[at : at + 64]] < 2) | ~np.isfinite(next_)
                out.append(np.where(alone, 0, (next_ - near) / np.where(alone, 1, np.maximum(np.maximum(next_, near), 1e-300))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["s"])

    parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, all_rows.num_rows // 64))
    return some.repartition(parts).mapInArrow(run, "s double").agg(F.avg("s").alias("score"))


def silhouette_squared(rows: DataFrame) -> DataFrame:
    """score: mean silhouette of all rows (item_id, cluster_id, embedding) by squared Euclidean distance. A point alone in its cluster counts 0.

    The mean squared distance of a point to a cluster follows from the cluster's mean vector and mean squared length, which are summed in a first pass; the second
    scores each row against these (a few numbers for each cluster and place, which are broadcast).
    """
    vector = array_to_vector(F.col("embedding").cast("array<double>")).alias("v")
    found = rows.select("cluster_id", vector).groupBy("cluster_id").agg(Summarizer.metrics("count", "mean", "normL2").summary(F.col("v")).alias("s")).orderBy("cluster_id").collect()
    names, sizes = np.array([r.cluster_id for r in found]), np.array([r.s["count"] for r in found], float)
    means = np.array([r.s["mean"].toArray() for r in found])
    squares = np.array([(r.s["normL2"].toArray() ** 2).sum() for r in found]) / np.maximum(sizes, 1)
    shared = rows.sparkSession.sparkContext.broadcast((names, sizes, means, squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, means, squares = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = matrix(batch.column("v"), unit=False), np.searchsorted(names, batch.column("cluster_id").to_numpy())
            mean, at = (x * x).sum(axis=1)[:, None] - 2 * x @ means.T + squares, np.arange(len(x))
            near = mean[at, own] * sizes[own] / np.maximum(sizes[own] - 1, 1)
            mean[at, own] = np.inf
            next_ = mean.min(axis=1)
            alone = (sizes[own] < 2) | ~np.isfinite(next_)
            s = np.where(alone, 0, (next_ - near) / np.where(alone, 1, np.maximum(np.maximum(next_, near), 1e-300)))
            yield pa.RecordBatch.from_arrays([pa.array([s.sum()]), pa.array([len(s)], pa.int64())], ["s", "n"])

    some = rows.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("v"))
    return some.mapInArrow(run, "s double, n long").agg((F.sum("s") / F.sum("n")).alias("score"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    all_mean = centroids(rows.withColumn("cluster_id", F.lit(0))).select(F.col("centroid").alias("mean"))
    c = centroids(rows)
    within = rows.join(c, "cluster_id").agg(F.sum(F.pow(euclidean_distance("embedding", "centroid"), 2)).alias("w"), F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m"))
    between = c.join(sizes, "cluster_id").crossJoin(F.broadcast(all_mean)).agg(F.sum(F.col("m") * F.pow(euclidean_distance("centroid", "mean"), 2)).alias("b"), F.count(F.lit(1)).alias("k"))
    return between.crossJoin(within).select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("score"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    c = centroids(rows)
    spread = rows.join(c, "cluster_id").groupBy("cluster_id", "centroid").agg(F.avg(euclidean_distance("embedding", "centroid")).alias("s"))
    a, b = spread.alias("a"), spread.alias("b")
    worst = a.join(b, F.col("a.cluster_id") != F.col("b.cluster_id")).groupBy("a.cluster_id").agg(F.max((F.col("a.s") + F.col("b.s")) / euclidean_distance("a.centroid", "b.centroid")).alias("r"))
    return worst.agg(F.avg("r").alias("score"))


METRICS = {"silhouette": (silhouette, 1), "calinski": (calinski_harabasz, 1), "davies": (davies_bouldin, -1)}


def sample(items: DataFrame, n: int) -> DataFrame:
    """n rows without replacement, the same at each run: those of smallest id hash."""
    return items.orderBy(F.md5(F.col("item_id").cast("string")), "item_id").limit(n)


def auto_k(items: DataFrame, k_min: int, k_max: int, metric: str = "silhouette", sample_size: int = SAMPLE) -> tuple[int, dict[int, float]]:
    """(best k, scores) on a sample; ties take the smallest k, and a k whose score is null is skipped."""
    score, sign = METRICS[metric]
    some = sample(items, sample_size).select("item_id", l2_normalize("embedding").alias("embedding")).cache()
    found: dict[int, float] = {}
    for k in range(max(2, k_min), max(2, k_max) + 1):
        value = score(some.join(kmeans(some, k), "item_id")).first()[0]
        if value is not None:
            found[k] = value
    some.unpersist()
    return min(found, key=lambda k: (-sign * found[k], k), default=max(2, k_min)), found


def name_clusters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster_id, name, score: the label (label_id, label, vector) nearest to each cluster's mean of unit vectors."""
    c = centroids(rows.select("cluster_id", l2_normalize("embedding").alias("embedding")))
    scored = c.crossJoin(labels).withColumn("score", F.round(cosine_similarity("centroid", "vector"), 9))
    best = scored.groupBy("cluster_id").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("label_id"))).alias("b"))
    return best.select("cluster_id", F.coalesce(F.expr("nullif(b.label, '')"), F.concat(F.lit("C"), F.col("cluster_id"))).alias("name"), "b.score")


def fallback_name(name, cluster_id):
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("C"), cluster_id.cast("string")))


def compress(items: DataFrame, dims: int, vector: str = "embedding", extra: int | None = None):
    """(item_id, compressed), model (a dims x width matrix of components, and the mean), retained variance; vectors as they are, and no
    model, where there are no more than `dims` items.

    All rows of any width are fitted, in two passes (see rangefinder), and projected in a third, whose rows are written. `extra`: directions that the fit keeps beyond `dims`.
    """
    rows = items.where(F.col(vector).isNotNull()).select("item_id", F.col(vector).cast("array<double>").alias("v"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n <= dims:
        return rows.select("item_id", F.col("v").alias("compressed")), None, 1.0
    model = rangefinder.components(rows.select("v"), dims, width, n, extra)
    whole = model.pop("variance")
    model["components"] = _signed(model["components"])
    out = cut(apply_compression(items, model, vector), "compressed")
    kept = out.agg(F.sum(F.aggregate("compressed", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    return out, model, min(1.0, kept / whole) if whole > 0 else 1.0


def _signed(components: np.ndarray) -> np.ndarray:
    """The largest part of each component is positive, so that a fit gives the same signs each time."""
    sign = np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])
    return components * np.where(sign == 0, 1, sign)[:, None]


def apply_compression(items: DataFrame, model: dict, vector: str = "embedding") -> DataFrame:
    """Project vectors, a query's too, through the kept model."""
    shared = items.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = (matrix(batch.column("v"), unit=False) - shared.value["mean"]) @ shared.value["components"].T
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(list(out), pa.list_(pa.float64()))], ["item_id", "compressed"])

    rows = items.where(F.col(vector).isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(project, "item_id long, compressed array<double>")


def gram_search(items: DataFrame, queries: DataFrame, model: dict | None = None, feature: str = "gram", k: int = 20) -> DataFrame:
    """query_id, rank, item_id, score: the k items of highest cosine of a stored feature for each query. A query's full vector goes through the
    model that compressed the stored ones; a table without the feature is an error."""
    if feature not in items.columns:
        raise FeatureAbsent(f"the items have no {feature}")
    if model is not None:
        queries = apply_compression(queries.withColumnRenamed("query_id", "item_id"), model, feature).toDF("query_id", feature)
    return knn_join(items, queries, k, feature).select("query_id", "rank", "item_id", (1 - F.col("distance")).alias("score"))


def layout(items: DataFrame, dims: int = 2) -> DataFrame:
    """item_id, x, y[, z]: the first principal components as floats."""
    out, *_ = compress(items.select("item_id", l2_normalize("embedding").alias("embedding")), dims)
    return out.select("item_id", *(F.element_at("compressed", k + 1).cast("float").alias("xyz"[k]) for k in range(dims)))


def build_report(items: DataFrame, labels: DataFrame, k: int, dims: int = 2) -> DataFrame:
    """One latent row per item: coordinates, cluster and cluster name."""
    clusters = kmeans(items, k).cache()
    named = name_clusters(items.join(clusters, "item_id"), labels)
    return layout(items, dims).join(clusters, "item_id").join(F.broadcast(named.select("cluster_id", F.col("name").alias("label"))), "cluster_id")


def rank_in(cluster: str, order: str):
    return F.row_number().over(Window.partitionBy(cluster).orderBy(order))
