"""Queries over point signatures and colour transfer."""

from __future__ import annotations

import uuid

from prismar.functions.vectors import distance_to_similarity
from prismar.operators import palettes
from prismar.operators import points as P
from prismar.operators.cuts import shared_dir
from prismar.operators.sparse import sparse_top_k
from prismar.registry import query, table
from prismar.sources import media, sinks
from pyspark.sql import Window
from pyspark.sql import functions as F

PTS = "SELECT l_suppkey AS item_id, l_orderkey * 10 + l_linenumber AS point_id, CAST(l_quantity AS DOUBLE) * 5 AS p1, CAST(l_discount AS DOUBLE) * 2500 + 0.0 AS p2, CAST(l_tax AS DOUBLE) * 3000 + 0.0 AS p3 FROM lineitem"
R6 = lambda x, n: f"round({x}, 6) + 0.0 AS {n}"


def pts(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    c = lambda n, k: (F.col(n).cast("double") * k + 0.0)
    return t.select(F.col("l_suppkey").alias("item_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), c("l_quantity", 5).alias("p1"), c("l_discount", 2500).alias("p2"), c("l_tax", 3000).alias("p3"))


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6) + 0.0)
    return df


_b = lambda c: f"least(floor({c} / 16), 15)"
HIST = f"SELECT item_id, bin, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS value FROM (SELECT item_id, CAST(({_b('p1')} * 16 + {_b('p2')}) * 16 + {_b('p3')} AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS n FROM ({PTS}) GROUP BY ALL)"


@query("P3", f"SELECT item_id, bin, {R6('value', 'value')} FROM ({HIST})")
def p3(spark, sf_dir):
    return rounded(P.histogram(pts(spark, sf_dir)), "value")


_m = lambda c: f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, CASE WHEN stddev_pop({c}) > 1e-8 THEN (avg({c}*{c}*{c}) - 3*avg({c})*avg({c}*{c}) + 2*avg({c})**3) / stddev_pop({c})**3 ELSE 0 END AS {c}_skew"
MOM = f"SELECT item_id, {', '.join(_m(c) for c in P.CHANNELS)} FROM ({PTS}) GROUP BY item_id"
NAMES = [f"{c}_{n}" for c in P.CHANNELS for n in ("mean", "std", "skew")]


@query("P5", f"SELECT item_id, {', '.join(R6(n, n) for n in NAMES)} FROM ({MOM})")
def p5(spark, sf_dir):
    return rounded(P.moments(pts(spark, sf_dir)), *NAMES)


@query("P4")
def p4(spark, sf_dir):
    return P.dominant(pts(spark, sf_dir))


PAL = f"SELECT item_id, pos, w, p1, p2, p3 FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n DESC, bin) AS INTEGER) AS pos, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY item_id) AS w, (bin // 16) * 16e0 + 8 AS p1, (bin % 16) * 16e0 + 8 AS p2, 128e0 AS p3 FROM (SELECT item_id, CAST({_b('p1')} * 16 + {_b('p2')} AS INTEGER) AS bin, count(*) AS n FROM ({PTS}) GROUP BY ALL)) WHERE pos <= 8"
TOP = f"SELECT item_id, pos, w / sum(w) OVER (PARTITION BY item_id) AS w, p1, p2, p3 FROM ({PAL}) WHERE pos <= 5"


def palette(spark, sf_dir):
    """A palette of the eight fullest cells of each bag."""
    cell = lambda c: F.least(F.floor(F.col(c) / 16), F.lit(15)).cast("int")
    n = pts(spark, sf_dir).groupBy("item_id", (cell("p1") * 16 + cell("p2")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("item_id")
    out = n.select("item_id", F.row_number().over(w.orderBy(F.desc("n"), "bin")).alias("pos"), (F.col("n") / F.sum("n").over(w)).alias("w"), (F.floor(F.col("bin") / 16) * 16.0 + 8).alias("p1"), (F.col("bin") % 16 * 16.0 + 8).alias("p2"), F.lit(128.0).alias("p3"))
    return out.where("pos <= 8")


@query("P4_step", f"WITH d AS (SELECT p.item_id, p.p1, p.p2, p.p3, pos, row_number() OVER (PARTITION BY row ORDER BY round((p.p1 - c.p1) ** 2 + (p.p2 - c.p2) ** 2 + (p.p3 - c.p3) ** 2, 6), pos) AS r FROM (SELECT *, row_number() OVER () AS row FROM ({PTS})) p JOIN ({PAL}) c USING (item_id)) SELECT item_id, pos, count(*) AS n, {', '.join(R6(f'avg({c})', c) for c in P.CHANNELS)} FROM d WHERE r = 1 GROUP BY item_id, pos")
def p4_step(spark, sf_dir):
    """One step of all items' k-means at once, from the eight fullest cells of each."""
    given = palettes.gathered(palette(spark, sf_dir))
    return rounded(palettes.lloyd_step(pts(spark, sf_dir).withColumn("w", F.lit(1)), given, given.count(), 8), *P.CHANNELS)


@query("P4_all")
def p4_all(spark, sf_dir):
    return palettes.dominant_all(pts(spark, sf_dir), rounds=8)


@query("P6", f"SELECT item_id, pos, {R6('w', 'w')} FROM ({TOP})")
def p6(spark, sf_dir):
    return rounded(P.top_share(palette(spark, sf_dir), 5), "w").select("item_id", "pos", "w")


STRIP = f"SELECT item_id, pos, width, CAST(coalesce(sum(width) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x0 FROM (SELECT item_id, pos, CAST(floor(round(w, 9) * 200) AS BIGINT) AS width FROM ({TOP}))"


@query("P8", f"SELECT item_id, pos, x0, CASE WHEN pos = max(pos) OVER (PARTITION BY item_id) THEN 200 - x0 ELSE width END AS width FROM ({STRIP})")
def p8(spark, sf_dir):
    return P.strip(P.top_share(palette(spark, sf_dir), 5).withColumn("w", F.round("w", 9)), 200).select("item_id", "pos", "x0", "width")


W1 = f"""WITH p AS (SELECT item_id, w, unnest([0, 1, 2]) AS ch, unnest([p1, p2, p3]) AS x FROM ({TOP})),
 ids AS (SELECT q.item_id AS query_id, i.item_id FROM (SELECT DISTINCT item_id FROM p WHERE item_id % 50 = 0) q, (SELECT DISTINCT item_id FROM p) i),
 u AS (SELECT query_id, item_id, ch, x, sum(m) AS m FROM (SELECT query_id, ids.item_id, ch, x, w AS m FROM ids JOIN p ON p.item_id = query_id UNION ALL SELECT query_id, ids.item_id, ch, x, -w FROM ids JOIN p ON p.item_id = ids.item_id) GROUP BY ALL),
 s AS (SELECT query_id, item_id, ch, abs(sum(m) OVER (w ROWS UNBOUNDED PRECEDING)) * (lead(x) OVER w - x) AS g FROM u WINDOW w AS (PARTITION BY query_id, item_id, ch ORDER BY x))
 SELECT query_id, item_id, avg(d) AS distance FROM (SELECT query_id, item_id, ch, sum(coalesce(g, 0)) AS d FROM s GROUP BY ALL) GROUP BY query_id, item_id"""


@query("G1", f"SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {R6('distance', 'distance').split(' AS ')[0]}, item_id) AS rank, item_id, {R6('distance', 'distance')} FROM ({W1}))")
def g1(spark, sf_dir):
    """Every palette is ranked for each query."""
    top = P.top_share(palette(spark, sf_dir), 5)
    return P.wasserstein(top.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), top)


TWO = f"SELECT item_id, pos, w / sum(w) OVER (PARTITION BY item_id) AS w, p1, p2, p3 FROM ({PAL}) WHERE pos <= 2"
#: Of palettes of two points with weights (a, 1 - a) and (b, 1 - b) the best plan sends as much as it can, or as little, from the first point to the first.
EMD2 = f"""WITH t AS (SELECT item_id, max(w) FILTER (pos = 1) AS w, max(p1) FILTER (pos = 1) AS x1, max(p2) FILTER (pos = 1) AS y1, max(p1) FILTER (pos = 2) AS x2, max(p2) FILTER (pos = 2) AS y2 FROM ({TWO}) GROUP BY item_id),
 d AS (SELECT a.item_id AS query_id, b.item_id, a.w AS a, b.w AS b, sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) AS c11, sqrt((a.x1 - b.x2) ** 2 + (a.y1 - b.y2) ** 2) AS c12, sqrt((a.x2 - b.x1) ** 2 + (a.y2 - b.y1) ** 2) AS c21, sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) AS c22 FROM t a, t b WHERE a.item_id % 50 = 0),
 e AS (SELECT query_id, item_id, round(least(least(a, b) * c11 + (a - least(a, b)) * c12 + (b - least(a, b)) * c21 + (1 - a - b + least(a, b)) * c22, greatest(a + b - 1, 0) * c11 + (a - greatest(a + b - 1, 0)) * c12 + (b - greatest(a + b - 1, 0)) * c21 + (1 - a - b + greatest(a + b - 1, 0)) * c22), 6) + 0.0 AS distance FROM d)
 SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS INTEGER) AS rank, item_id, distance, max(distance) OVER (PARTITION BY query_id) AS furthest FROM e)"""


def pairs(spark, sf_dir):
    """Palettes of two points, so that SQL can tell the best plan too, and every 50th of them as a query."""
    p = P.palettes(P.top_share(palette(spark, sf_dir), 2))
    return p, p.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")


@query("G2", f"SELECT query_id, rank, item_id, distance FROM ({EMD2}) WHERE rank <= 5")
def g2(spark, sf_dir):
    return P.emd_top_k(*pairs(spark, sf_dir), 5)


@query("K3", f"WITH h AS ({HIST}), i AS (SELECT DISTINCT item_id FROM h), d AS (SELECT a.item_id AS query_id, b.item_id, sum(a.value * b.value) AS dot FROM h a JOIN h b USING (bin) WHERE a.item_id % 50 = 0 GROUP BY ALL), s AS (SELECT q.item_id AS query_id, i.item_id, round(coalesce(dot, 0), 6) + 0.0 AS score FROM i q JOIN i ON q.item_id % 50 = 0 LEFT JOIN d ON d.query_id = q.item_id AND d.item_id = i.item_id) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, item_id, score FROM s) WHERE rank <= 20")
def k3(spark, sf_dir):
    """Sparse unit histograms: the cosine is a sum over shared bins."""
    h = P.histogram(pts(spark, sf_dir)).withColumnRenamed("bin", "place")
    return sparse_top_k(h, h.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), 20)


@query("K4", f"WITH m AS ({MOM}) SELECT item_id, round(1 - d / (max(d) OVER () + 1e-8), 6) + 0.0 AS score FROM (SELECT b.item_id, sqrt({' + '.join(f'(a.{n} - b.{n}) ** 2' for n in NAMES)}) AS d FROM m a, m b WHERE a.item_id = 1)")
def k4(spark, sf_dir):
    m = P.moments(pts(spark, sf_dir))
    q = F.broadcast(m.where("item_id = 1").limit(1).select(*(F.col(n).alias(f"q_{n}") for n in NAMES)))
    d = m.crossJoin(q).select(F.lit(1).alias("query_id"), "item_id", F.sqrt(sum(F.pow(F.col(n) - F.col(f"q_{n}"), 2) for n in NAMES)).alias("distance"))
    return rounded(distance_to_similarity(d, "query_id"), "score").select("item_id", "score")


@query("K5", f"SELECT query_id, rank, item_id, round(1 - distance / (furthest + 1e-8), 6) + 0.0 AS score FROM ({EMD2}) WHERE rank <= 20")
def k5(spark, sf_dir):
    return rounded(P.emd_scores(*pairs(spark, sf_dir), 20), "score")


STATS = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in P.CHANNELS)
MOVED = lambda c, k: f"least(greatest(({k} * ((p.{c} - o.{c}_m) * s.{c}_s / greatest(o.{c}_s, 1e-6) + s.{c}_m) + {1 - k}e0 * p.{c}), 0e0), 255e0)"
TRANSFER = lambda content, style, k=1: f"WITH p AS ({PTS}), o AS (SELECT item_id, {STATS} FROM p GROUP BY item_id), s AS (SELECT item_id AS style_id, {STATS} FROM p WHERE {style} GROUP BY item_id) SELECT p.item_id, s.style_id, point_id, {', '.join(R6(MOVED(c, k), c) for c in P.CHANNELS)} FROM p JOIN o USING (item_id), s WHERE {content}"


def moved(spark, sf_dir, content, style, strength=1.0):
    p = pts(spark, sf_dir)
    styles = p.where(style).withColumnRenamed("item_id", "style_id").drop("point_id")
    return rounded(P.transfer(p.where(content), styles, strength), *P.CHANNELS)


@query("L1", TRANSFER("p.item_id = 2", "item_id = 1", 0.5))
def l1(spark, sf_dir):
    return moved(spark, sf_dir, "item_id = 2", "item_id = 1", 0.5)


@query("L2", TRANSFER("p.item_id <> 1", "item_id = 1"))
def l2(spark, sf_dir):
    return moved(spark, sf_dir, "item_id <> 1", "item_id = 1")


@query("L3", TRANSFER("p.item_id = 1", "item_id <> 1"))
def l3(spark, sf_dir):
    return moved(spark, sf_dir, "item_id = 1", "item_id <> 1")


@query("L4", f"WITH t AS ({PTS}), lut AS (SELECT CAST(floor(p1) AS INTEGER) AS v, avg(least(p1 * 0.5e0 + 60, 255)) AS mapped FROM t WHERE item_id % 2 = 0 GROUP BY 1) SELECT point_id, 0 AS channel, CAST(floor(least(greatest(coalesce(mapped, floor(p1)), 0e0), 255e0)) AS INTEGER) AS value FROM t LEFT JOIN lut ON v = CAST(floor(p1) AS INTEGER)")
def l4(spark, sf_dir):
    p = pts(spark, sf_dir)
    one = p.select("item_id", "point_id", F.lit(0).alias("channel"), F.col("p1").alias("value"))
    seen = one.where("item_id % 2 = 0")
    styled = seen.withColumn("styled", F.least(F.col("value") * 0.5 + 60, F.lit(255.0)))
    return P.apply_lut(one.drop("item_id"), P.empirical_lut(styled)).select("point_id", "channel", "value")


@query("S7", f"SELECT item_id, {R6('p1_mean', 'p1_mean')} FROM ({MOM})")
def s7(spark, sf_dir):
    """The features are written, and one of them is scanned from the table."""
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    sinks.write_features(P.moments(pts(spark, sf_dir)), "p1_mean", path)
    return rounded(media.scan_features(spark, path, "p1_mean"), "p1_mean")
