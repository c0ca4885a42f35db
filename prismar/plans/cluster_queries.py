"""Queries over clustering, naming, sampling and projection."""

from __future__ import annotations

from prismar.operators import cluster, smoothing
from prismar.plans.search_queries import D
from prismar.registry import query, table
from pyspark.sql import functions as F


def given(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("cluster_id"))


def label_vectors(spark, sf_dir):
    """A label for each class: its item of smallest id."""
    e = given(spark, sf_dir)
    return e.groupBy(F.col("cluster_id").alias("label_id")).agg(F.min_by("embedding", "item_id").alias("vector")).withColumn("label", F.concat(F.lit("label "), F.col("label_id")))


E = "WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v, label AS c FROM embeddings), "
LONG = "u AS (SELECT i, c, unnest(range(64)) AS p, unnest(v) AS x FROM e), m AS (SELECT c, p, avg(x) AS x FROM u GROUP BY c, p), mc AS (SELECT c, list(x ORDER BY p) AS v FROM m GROUP BY c) "


@query("C1")
def c1(spark, sf_dir):
    return cluster.kmeans(given(spark, sf_dir), 8)


@query("C2")
def c2(spark, sf_dir):
    best, scores = cluster.auto_k(given(spark, sf_dir), 2, 4, "calinski")
    return spark.createDataFrame([(k, float(s), k == best) for k, s in scores.items()], "k int, score double, best boolean")


@query("C2a", E.replace("FROM embeddings", "FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 5000") + "d AS (SELECT a.i, a.c, b.c AS o, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.i <> b.i GROUP BY ALL), s AS (SELECT i, min(d) FILTER (c = o) AS n, min(d) FILTER (c <> o) AS x FROM d GROUP BY i) SELECT round(avg(coalesce((x - n) / greatest(n, x), 0)), 6) + 0.0 AS score FROM s")
def c2a(spark, sf_dir):
    return cluster.silhouette(given(spark, sf_dir)).select((F.round("score", 6) + 0.0).alias("score"))


@query("C2a_squared", E + "z AS (SELECT c, count(*) AS n FROM e GROUP BY c), d AS (SELECT a.i, a.c, b.c AS o, sum(list_distance(a.v, b.v) ** 2) AS d FROM e a JOIN e b ON a.i <> b.i GROUP BY ALL), s AS (SELECT i, min(d / (n - 1)) FILTER (d.c = o) AS near, min(d / n) FILTER (d.c <> o) AS next FROM d JOIN z ON z.c = o GROUP BY i) SELECT round(avg(coalesce((next - near) / greatest(near, next), 0)), 6) + 0.0 AS score FROM s")
def c2a_squared(spark, sf_dir):
    """Of all rows, in closed form from the clusters' sums."""
    return cluster.silhouette_squared(given(spark, sf_dir)).select((F.round("score", 6) + 0.0).alias("score"))


@query("C2b", E + LONG + ", g AS (SELECT list(x ORDER BY p) AS v FROM (SELECT p, avg(x) AS x FROM u GROUP BY p)) SELECT round((SELECT sum(n * list_distance(mc.v, g.v) ** 2) FROM (SELECT c, count(*) AS n FROM e GROUP BY c) JOIN mc USING (c), g) / (SELECT count(*) - 1 FROM mc) / ((SELECT sum(list_distance(e.v, mc.v) ** 2) FROM e JOIN mc USING (c)) / ((SELECT count(*) FROM e) - (SELECT count(*) FROM mc))), 6) + 0.0 AS score")
def c2b(spark, sf_dir):
    return cluster.calinski_harabasz(given(spark, sf_dir)).select((F.round("score", 6) + 0.0).alias("score"))


@query("C2c", E + LONG + ", s AS (SELECT c, mc.v, avg(list_distance(e.v, mc.v)) AS s FROM e JOIN mc USING (c) GROUP BY ALL) SELECT round(avg(r), 6) + 0.0 AS score FROM (SELECT max((a.s + b.s) / list_distance(a.v, b.v)) AS r FROM s a JOIN s b ON a.c <> b.c GROUP BY a.c)")
def c2c(spark, sf_dir):
    return cluster.davies_bouldin(given(spark, sf_dir)).select((F.round("score", 6) + 0.0).alias("score"))


@query("C3", "WITH e AS (SELECT vec_id AS i, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-8)) AS v, label AS c FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)), " + LONG + ", l AS (SELECT label AS id, 'label ' || label AS label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings GROUP BY label) SELECT cluster_id, name, round(score, 6) + 0.0 AS score FROM (SELECT mc.c AS cluster_id, l.label AS name, round(list_cosine_similarity(mc.v, l.v), 9) AS score, row_number() OVER (PARTITION BY mc.c ORDER BY round(list_cosine_similarity(mc.v, l.v), 9) DESC, l.id) AS r FROM mc, l) WHERE r = 1")
def c3(spark, sf_dir):
    return cluster.name_clusters(given(spark, sf_dir), label_vectors(spark, sf_dir)).withColumn("score", F.round("score", 6) + 0.0)


@query("C4", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'C' || doc_id ELSE source END AS name FROM documents")
def c4(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("name", F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("source")))
    return d.select("doc_id", cluster.fallback_name(F.col("name"), F.col("doc_id")).alias("name"))


@query("C6")
def c6(spark, sf_dir):
    out, _, kept = cluster.compress(given(spark, sf_dir), 16)
    return out.withColumn("retained", F.lit(kept))


@query("C7")
def c7(spark, sf_dir):
    return cluster.layout(given(spark, sf_dir), 3)


_step = lambda n: f"r{n} AS (SELECT b.item_id, coalesce(0.5e0 * b.x + 0.5e0 * m.x, b.x) AS x, coalesce(0.5e0 * b.y + 0.5e0 * m.y, b.y) AS y FROM r0 b LEFT JOIN (SELECT g.a, sum(w * p.x) / sum(w) AS x, sum(w * p.y) / sum(w) AS y FROM g JOIN r{n - 1} p ON p.item_id = g.b GROUP BY g.a) m ON m.a = b.item_id)"


@query("C7_smooth", f"WITH n AS (SELECT query_id AS a, item_id AS b FROM (SELECT q.vec_id AS query_id, e.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {D}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE e.vec_id <> q.vec_id) WHERE rank <= 5), g AS (SELECT a, b, count(*) AS w FROM (SELECT a, b FROM n UNION ALL SELECT b, a FROM n) GROUP BY a, b), r0 AS (SELECT vec_id AS item_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), {_step(1)}, {_step(2)}, {_step(3)} SELECT item_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM r3")
def c7_smooth(spark, sf_dir):
    """Three rounds from the vectors' first two places, over their five nearest neighbours."""
    e = given(spark, sf_dir)
    start = e.select("item_id", F.element_at("embedding", 1).alias("x"), F.element_at("embedding", 2).alias("y"))
    out = smoothing.smooth(start, smoothing.neighbour_graph(e, 5), 0.5, rounds=3, tolerance=0.0)
    return out.select("item_id", *((F.round(c, 6) + 0.0).alias(c) for c in "xy"))


@query("C8", "SELECT vec_id AS item_id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 100")
def c8(spark, sf_dir):
    return cluster.sample(given(spark, sf_dir), 100).select("item_id")


@query("C9")
def c9(spark, sf_dir):
    return cluster.build_report(given(spark, sf_dir).drop("cluster_id"), label_vectors(spark, sf_dir), 6)
