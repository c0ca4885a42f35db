"""Queries over rasters and feature maps (P1, T1-T6, K6-K8): vectors read as 8 x 8 rasters, or 8 channels of 8 places."""

from __future__ import annotations

from prismar.operators import cluster
from prismar.operators import raster as R
from prismar.operators.sparse import sparse_top_k
from prismar.registry import query, table
from pyspark.sql import functions as F

RAS = "SELECT vec_id AS item_id, i // 8 AS y, i % 8 AS x, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings)"


def ras(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("i", "e"))
    return e.select("item_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("e").cast("double").alias("v"))


def maps(spark, sf_dir):
    return ras(spark, sf_dir).select("item_id", F.lit(0).alias("layer"), F.col("y").alias("c"), F.col("x").alias("pos"), "v")


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6) + 0.0)
    return df


@query("P1", f"SELECT item_id, y // 2 AS y, x // 2 AS x, round(avg(v), 6) + 0.0 AS v FROM ({RAS}) GROUP BY ALL")
def p1(spark, sf_dir):
    return rounded(R.block_mean(ras(spark, sf_dir), 2), "v")


_v = ", ".join(f"({dy}, {dx}, {wx}, {wy})" for (dy, dx), (wx, wy) in R.SOBEL.items())
_fold = lambda p: f"CASE WHEN {p} < 0 THEN -({p}) WHEN {p} >= 8 THEN 14 - ({p}) ELSE {p} END"
SOB = f"SELECT p.item_id, p.y, p.x, sum(n.v * k.wx) AS gx, sum(n.v * k.wy) AS gy FROM ras p, (VALUES {_v}) k(dy, dx, wx, wy), ras n WHERE n.item_id = p.item_id AND n.y = {_fold('p.y + k.dy')} AND n.x = {_fold('p.x + k.dx')} GROUP BY ALL"


@query("T1", f"WITH ras AS ({RAS}) SELECT item_id, y, x, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy FROM ({SOB})")
def t1(spark, sf_dir):
    return rounded(R.sobel(ras(spark, sf_dir)), "gx", "gy")


EDGE = f"WITH ras AS ({RAS}), g AS ({SOB}), b AS (SELECT item_id, CAST((y // 2) * 4 + x // 2 AS INTEGER) AS cell, CAST(least(floor(round(((degrees(atan2(gy, gx)) + 180e0) % 180e0), 9) / 11.25e0), 15) AS INTEGER) AS bin, sum(sqrt(gx * gx + gy * gy)) AS s FROM g GROUP BY ALL), h AS (SELECT item_id, cell, bin, CASE WHEN sqrt(sum(s * s) OVER w) > 1e-8 THEN s / sqrt(sum(s * s) OVER w) ELSE s END AS value FROM b WHERE s > 0 WINDOW w AS (PARTITION BY item_id, cell)) "


@query("T2", EDGE + "SELECT item_id, cell, bin, round(value, 6) + 0.0 AS value FROM h")
def t2(spark, sf_dir):
    return rounded(R.edge_histogram(ras(spark, sf_dir)), "value")


_n = ", ".join(f"({dy}, {dx}, {1 << p})" for p, (dy, dx) in enumerate(R.NEIGHBOURS))
LBP = f"WITH ras AS ({RAS}), c AS (SELECT p.item_id, p.y, p.x, CAST(CASE WHEN p.y IN (0, 7) OR p.x IN (0, 7) THEN 0 ELSE sum(CASE WHEN n.v >= p.v THEN k.bit ELSE 0 END) END AS INTEGER) AS code FROM ras p, (VALUES {_n}) k(dy, dx, bit), ras n WHERE n.item_id = p.item_id AND n.y = p.y + k.dy AND n.x = p.x + k.dx GROUP BY p.item_id, p.y, p.x), u AS (SELECT item_id, CAST((y // 2) * 4 + x // 2 AS INTEGER) AS cell, CAST(CASE WHEN bit_count(xor(code, (code >> 1) | ((code & 1) << 7))) <= 2 THEN bit_count(code) ELSE 9 END AS INTEGER) AS bin, count(*) AS n FROM c GROUP BY ALL), h AS (SELECT item_id, cell, bin, n / sum(n) OVER (PARTITION BY item_id, cell) AS value FROM u) "


@query("T3", LBP + "SELECT item_id, y, x, code FROM c")
def t3(spark, sf_dir):
    return R.lbp_codes(ras(spark, sf_dir))


@query("T4", LBP + "SELECT item_id, cell, bin, round(value, 6) + 0.0 AS value FROM h")
def t4(spark, sf_dir):
    return rounded(R.lbp_histogram(ras(spark, sf_dir)), "value")


GRAM = f"WITH ras AS ({RAS}), h AS (SELECT a.item_id, a.y AS c1, b.y AS c2, sum(a.v * b.v) / 64 AS value FROM ras a JOIN ras b ON a.item_id = b.item_id AND a.x = b.x AND a.y <= b.y GROUP BY ALL) "


@query("T5", GRAM + "SELECT item_id, 0 AS layer, c1, c2, round(value, 6) + 0.0 AS value FROM h")
def t5(spark, sf_dir):
    return rounded(R.gram(maps(spark, sf_dir)), "value")


_place = {"edge": f"{EDGE} SELECT item_id, 'edge' AS feature, (cell * 16 + bin)::VARCHAR AS place, value FROM h", "lbp": f"{LBP} SELECT item_id, 'lbp' AS feature, (cell * 10 + bin)::VARCHAR AS place, value FROM h", "gram": f"{GRAM} SELECT item_id, 'gram' AS feature, '0:' || c1 || ':' || c2 AS place, value FROM h WHERE item_id % 5 <> 0"}


@query("T6", "SELECT item_id, feature, place, round(value, 6) + 0.0 AS value FROM (" + " UNION ALL ".join(f"SELECT * FROM ({q})" for q in _place.values()) + ")")
def t6(spark, sf_dir):
    """The places of all three features; every fifth item has no feature maps, so that its gram is null."""
    f = R.style_features(ras(spark, sf_dir), maps(spark, sf_dir).where("item_id % 5 <> 0"))
    rows = [f.select("item_id", F.lit(c).alias("feature"), F.explode(c).alias("place", "value")).withColumn("place", F.col("place").cast("string")) for c in ("edge", "lbp", "gram")]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]), "value")


#: The 20 items of highest cosine for every 50th item, ties to the smaller id; items without a shared place score 0.
RANKED = lambda on: f", l AS (SELECT item_id, sqrt(sum(value * value)) AS len FROM h WHERE value <> 0 GROUP BY item_id), d AS (SELECT a.item_id AS query_id, b.item_id, sum(a.value * b.value) AS dot FROM h a JOIN h b USING ({on}) WHERE a.item_id % 50 = 0 GROUP BY ALL), s AS (SELECT q.item_id AS query_id, l.item_id, round(coalesce(dot, 0) / (l.len * q.len), 6) + 0.0 AS score FROM l q JOIN l ON q.item_id % 50 = 0 LEFT JOIN d ON d.query_id = q.item_id AND d.item_id = l.item_id) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, item_id, score FROM s) WHERE rank <= 20"


def ranked(features, *axes):
    """`axes`: the places of a feature and how many there are of the last one."""
    first, second, n = axes
    f = features.select("item_id", (F.col(first) * n + F.col(second)).alias("place"), "value")
    return sparse_top_k(f, f.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), 20)


@query("K6", EDGE.rstrip() + RANKED("cell, bin"))
def k6(spark, sf_dir):
    return ranked(R.edge_histogram(ras(spark, sf_dir)), "cell", "bin", R.ORIENTATIONS)


@query("K7", LBP.rstrip() + RANKED("cell, bin"))
def k7(spark, sf_dir):
    return ranked(R.lbp_histogram(ras(spark, sf_dir)), "cell", "bin", 10)


CENTRED = GRAM.rstrip() + ", m AS (SELECT c1, c2, avg(value) AS mean FROM h GROUP BY ALL), z AS (SELECT item_id, c1, c2, value - mean AS value FROM h JOIN m USING (c1, c2)), l AS (SELECT item_id, sqrt(sum(value * value)) AS len FROM z GROUP BY item_id), s AS (SELECT a.item_id AS query_id, b.item_id, round(1 - sum(a.value * b.value) / (any_value(q.len) * any_value(l.len)), 9) AS d FROM z a JOIN z b USING (c1, c2) JOIN l q ON q.item_id = a.item_id JOIN l ON l.item_id = b.item_id WHERE a.item_id % 50 = 0 GROUP BY a.item_id, b.item_id) SELECT query_id, rank, item_id, round(1 - d, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank FROM s) WHERE rank <= 20"


@query("K8", CENTRED)
def k8(spark, sf_dir):
    """Stored gram vectors are compressed to all their 36 components, and each query's full vector goes through the same model: by SQL, cosines of centred vectors."""
    places = F.array_sort(F.collect_list(F.struct("c1", "c2", "value")))
    full = R.gram(maps(spark, sf_dir)).groupBy("item_id").agg(F.transform(places, lambda p: p["value"]).alias("gram"))
    stored, model, _ = cluster.compress(full, 36, "gram")
    queries = full.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    return rounded(cluster.gram_search(stored.withColumnRenamed("compressed", "gram"), queries, model), "score")
