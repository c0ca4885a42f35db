"""Queries over search, top-k, fusion and grouping."""

from __future__ import annotations

import uuid

from prismar.functions.vectors import cosine_similarity
from prismar.operators import groups, search
from prismar.operators.cuts import shared_dir
from prismar.registry import query, table
from prismar.sources import layout as bucket_tables
from prismar.sources import media, sinks
from pyspark.sql import functions as F

D = "round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9)"
TOP = lambda n, qid=0: f"SELECT e.vec_id AS item_id, {D} + 0.0 AS distance, row_number() OVER (ORDER BY {D}, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {qid}) q ORDER BY distance, item_id LIMIT {n}"


def items(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def hits(spark, sf_dir, k, qid=0, carry=()):
    e = items(spark, sf_dir)
    return search.top_k(e, e.where(F.col("item_id") == qid), k, carry=carry)


@query("K1", f"SELECT t.item_id, distance, rank, label FROM ({TOP(10)}) t JOIN embeddings ON vec_id = t.item_id")
def k1(spark, sf_dir):
    return hits(spark, sf_dir, 10, carry=("label",))


KNN = f"SELECT query_id, rank, item_id, distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS item_id, {D} + 0.0 AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {D}, e.vec_id) AS rank FROM embeddings e, embeddings q) WHERE rank <= "


@query("K2", KNN + "10")
def k2(spark, sf_dir):
    e = items(spark, sf_dir)
    return search.knn_join(e, e.withColumnRenamed("item_id", "query_id"), 10)


SCORES = """SELECT q.vec_id AS query_id, e.vec_id AS item_id, m.method, CASE WHEN m.method = 'edge' AND e.vec_id % 3 = 0 THEN NULL ELSE
 round(list_cosine_similarity(CAST(e.embedding[m.lo:m.hi] AS DOUBLE[]), CAST(q.embedding[m.lo:m.hi] AS DOUBLE[])), 9) END AS score
 FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, (VALUES ('histogram', 1, 32), ('edge', 33, 64)) m(method, lo, hi)"""


def scores(e, q):
    """Two methods over halves of the vectors; `edge` is absent for every third item."""
    both = e.join(F.broadcast(q)) if q.count() * 600 <= search.BROADCAST_BYTES else e.join(q)
    part = lambda c, a: F.slice(c, a, 32)
    one = lambda name, a: both.select("query_id", "item_id", F.lit(name).alias("method"), F.round(cosine_similarity(part("embedding", a), part("q", a)), 9).alias("score"))
    return one("histogram", 1).unionByName(one("edge", 33).where(F.col("item_id") % 3 != 0))


def halves(spark, sf_dir):
    """Items and queries with a feature for each method, as in `scores`."""
    e = items(spark, sf_dir)
    both = (F.slice("embedding", 1, 32).alias("histogram"), F.slice("embedding", 33, 32).alias("edge"))
    q = e.where(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query_id"), *both)
    return e.select("item_id", both[0], F.when(F.col("item_id") % 3 != 0, both[1]).alias("edge")), q


MINMAX = f"SELECT query_id, item_id, method, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END AS score FROM ({SCORES}) WHERE score IS NOT NULL WINDOW w AS (PARTITION BY query_id, method)"
FUSED = lambda src, a, b: f"SELECT query_id, item_id, round(sum(score * CASE method WHEN 'histogram' THEN {a} ELSE {b} END), 6) + 0.0 AS score FROM ({src}) WHERE score IS NOT NULL GROUP BY ALL"
BEST = lambda src, k: f"SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ({src})) WHERE rank <= {k}"
_r = lambda df: df.withColumn("score", F.round("score", 6) + 0.0)


@query("K9", BEST(FUSED(MINMAX, "0.4e0/0.7e0", "0.3e0/0.7e0"), 20))
def k9(spark, sf_dir):
    return search.fused_search(*halves(spark, sf_dir), {"histogram": 0.4, "edge": 0.3, "lbp": 0.0}, 20)


@query("K10", BEST(f"SELECT * FROM ({FUSED(SCORES, '0.5e0', '0.5e0')}) WHERE item_id <> query_id", 50))
def k10(spark, sf_dir):
    return search.fused_search(*halves(spark, sf_dir), {"histogram": 0.5, "edge": 0.5}, 50, "raw", without_self=True)


@query("K11", f"SELECT query_id, item_id, method, score FROM ({SCORES}) WHERE score IS NOT NULL AND item_id IN (SELECT item_id FROM ({TOP(150)}))")
def k11(spark, sf_dir):
    """The prompt's 150 items are picked before they are scored for every query."""
    e = items(spark, sf_dir)
    q = e.where(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"))
    return scores(search.prompt_filter(e, hits(spark, sf_dir, 150)), q).select("query_id", "item_id", "method", "score")


@query("K12", f"SELECT query_id, rank, item_id, distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS item_id, {D} + 0.0 AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {D}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 20")
def k12(spark, sf_dir):
    """The query's own item goes before the limit, inside the search."""
    e = items(spark, sf_dir)
    return search.knn_join(e, e.where(F.col("item_id") % 50 == 0).withColumnRenamed("item_id", "query_id"), 20, without_self=True)


@query("K13", f"SELECT query_id, rank, item_id, score, method AS method_used FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ({SCORES}) WHERE score IS NOT NULL AND method = CASE WHEN query_id % 100 = 0 THEN 'histogram' ELSE 'edge' END)")
def k13(spark, sf_dir):
    """Every second query wants a method that the items have, the others one that they haven't. All items are ranked, as in the reference."""
    e, q = halves(spark, sf_dir)
    wanted = F.when(F.col("query_id") % 100 == 0, "histogram").otherwise("gram").alias("wanted")
    return search.with_fallback_method(e, q.select("*", wanted), "edge")


NULLED = "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE embedding END AS embedding FROM embeddings"


@query("K14", f"SELECT q.vec_id AS query_id, e.vec_id AS item_id, 'histogram' AS method, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) + 0.0 AS score FROM ({NULLED}) e, (SELECT * FROM embeddings WHERE vec_id = 1) q WHERE e.embedding IS NOT NULL")
def k14(spark, sf_dir):
    e = items(spark, sf_dir)
    some = e.withColumn("embedding", F.when(F.col("item_id") % 7 != 0, F.col("embedding")))
    return _r(search.score_search(some, e.where("item_id = 1").withColumnRenamed("item_id", "query_id"), "embedding", cosine_similarity, "histogram"))


@query("K15", f"SELECT t.item_id, rank, round(embedding[1], 6) + 0.0 AS x, round(embedding[2], 6) + 0.0 AS y FROM ({TOP(25)}) t JOIN embeddings ON vec_id = t.item_id")
def k15(spark, sf_dir):
    latent = items(spark, sf_dir).select("item_id", *((F.round(F.element_at("embedding", k), 6) + 0.0).cast("float").alias(n) for k, n in ((1, "x"), (2, "y"))))
    return hits(spark, sf_dir, 25).select("item_id", "rank").join(latent, "item_id")


@query("K15_bucketed", f"SELECT t.item_id, rank, round(embedding[1], 6) + 0.0 AS x, p.page_id IS NOT NULL AS has_page FROM ({TOP(25)}) t JOIN embeddings ON vec_id = t.item_id LEFT JOIN pages p ON p.page_id = t.item_id")
def k15_bucketed(spark, sf_dir):
    """Hits joined with the latent table and the path table, both bucketed by item id, which therefore stay where they lie."""
    mark = uuid.uuid4().hex
    latent = items(spark, sf_dir).select("item_id", (F.round(F.element_at("embedding", 1), 6) + 0.0).cast("float").alias("x"))
    paths = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.lit(True).alias("page"))
    both = [bucket_tables.write_bucketed(df, f"{n}_{mark}", 8, path=f"{shared_dir(spark)}/{n}-{mark}") for n, df in (("latent", latent), ("paths", paths))]
    joined = both[0].join(both[1], "item_id", "left").join(hits(spark, sf_dir, 25).select("item_id", "rank"), "item_id")
    return joined.select("item_id", "rank", "x", F.coalesce("page", F.lit(False)).alias("has_page"))


@query("K16", f"SELECT scene, item_id, round(sqrt((x - lag(x) OVER (ORDER BY scene)) ** 2 + (y - lag(y) OVER (ORDER BY scene)) ** 2), 6) + 0.0 AS step FROM (SELECT query_id / 25 AS scene, item_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM (SELECT CAST(query_id AS BIGINT) // 1 AS query_id, item_id FROM ({KNN} 2) WHERE rank = 2 AND query_id % 25 = 0) JOIN embeddings ON vec_id = item_id)")
def k16(spark, sf_dir):
    """A story: one item for each scene (here every 25th vector, its own row left out), and the length of each leg of the path."""
    e = items(spark, sf_dir)
    q = e.where(F.col("item_id") % 25 == 0).withColumnRenamed("item_id", "query_id")
    best = search.knn_join(e, q, 2).where("rank = 2").select((F.col("query_id") / 25).alias("scene"), "item_id")
    at = best.join(e, "item_id").select("scene", "item_id", *(F.element_at("embedding", k).cast("double").alias(n) for k, n in ((1, "x"), (2, "y"))))
    return search.path_legs(at).select("scene", "item_id", (F.round("leg", 6) + 0.0).alias("step"))


@query("K17", "SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages)")
def k17(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.where(F.col("url") == pages.agg(F.min("url")).first()[0]).select("page_id", "url")


@query("K18", f"SELECT p.url, t.item_id, rank FROM ({TOP(50)}) t JOIN pages p ON p.page_id = t.item_id")
def k18(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), "url")
    return hits(spark, sf_dir, 50).join(pages, "item_id").select("url", "item_id", "rank")


REACH = f"""WITH RECURSIVE t AS (SELECT t.item_id, t.rank, t.distance, CAST(e.embedding AS DOUBLE[]) AS v FROM ({TOP(60)}) t JOIN embeddings e ON e.vec_id = t.item_id),
 near AS (SELECT a.rank AS a, b.rank AS b FROM t a, t b WHERE a.rank <> b.rank AND round(1 - list_cosine_similarity(a.v, b.v), 9) <= 0.7e0),
 reach AS (SELECT rank AS a, rank AS b FROM t UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b), first AS (SELECT a AS rank, min(b) AS f FROM reach GROUP BY a)"""
TWINS = REACH + " SELECT 'g' || (dense_rank() OVER (ORDER BY f) - 1) AS gid, CAST(row_number() OVER (PARTITION BY f ORDER BY rank) - 1 AS INTEGER) AS pos, item_id, rank FROM first JOIN t USING (rank)"


def twins(spark, sf_dir):
    return groups.twin_groups(hits(spark, sf_dir, 60, carry=("embedding",)).withColumn("query_id", F.lit(0)), 0.7)


@query("C5", TWINS)
def c5(spark, sf_dir):
    return twins(spark, sf_dir).drop("query_id")


@query("C5b", f"WITH RECURSIVE near AS (SELECT q.vec_id AS a, e.vec_id AS b FROM embeddings e, embeddings q WHERE e.vec_id <> q.vec_id AND {D} <= 0.55e0), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b) SELECT a AS item_id, min(b) AS comp FROM reach GROUP BY a")
def c5b(spark, sf_dir):
    return groups.corpus_twins(items(spark, sf_dir), 0.55)


@query("K19", f"SELECT gid, item_id, round(1 - distance, 6) + 0.0 AS score, members, row_number() OVER (ORDER BY f) AS place FROM (SELECT gid, f, arg_min(item_id, rank) AS item_id, arg_min(distance, rank) AS distance, count(*) AS members FROM ({REACH} SELECT 'g' || (dense_rank() OVER (ORDER BY f) - 1) AS gid, f, item_id, rank, distance FROM first JOIN t USING (rank)) GROUP BY ALL)")
def k19(spark, sf_dir):
    scored = hits(spark, sf_dir, 60).select("item_id", (1 - F.col("distance")).alias("score"))
    return _r(search.display_rank(twins(spark, sf_dir).join(scored, "item_id"))).drop("query_id")


@query("K20", "SELECT vec_id AS item_id, vec_id % 2 = 0 AS from_store, round(CASE WHEN vec_id % 2 = 0 THEN embedding[1] ELSE embedding[2] END, 6) + 0.0 AS feature FROM embeddings")
def k20(spark, sf_dir):
    e = items(spark, sf_dir)
    stored = e.where(F.col("item_id") % 2 == 0).select("item_id", F.element_at("embedding", 1).alias("feature"))
    out = search.with_fallback(e.select("item_id", F.element_at("embedding", 2).alias("second")), stored, "item_id", "feature", F.col("second"))
    return out.select("item_id", "from_store", (F.round("feature", 6) + 0.0).cast("float").alias("feature"))


@query("S6", "SELECT vec_id AS item_id, len(embedding) AS dims FROM embeddings WHERE label = 3 AND vec_id % 2 = 0")
def s6(spark, sf_dir):
    """The vectors are written by data set (here their label) and modality, and one of each is scanned: the other folders aren't read."""
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    kinds = (F.concat(F.lit("set"), "label").alias("dataset"), F.when(F.col("item_id") % 2 == 0, "image").otherwise("audio").alias("modality"))
    sinks.write_embeddings(items(spark, sf_dir).select("item_id", "embedding", *kinds), path)
    return media.scan_embeddings(spark, path, "set3", "image").select("item_id", F.size("embedding").cast("long").alias("dims"))
