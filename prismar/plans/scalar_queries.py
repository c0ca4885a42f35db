"""Queries over vector, colour and text functions."""

from __future__ import annotations

from prismar.functions import colors, strings, vectors
from prismar.registry import query, table
from pyspark.sql import functions as F


def pairs(spark, sf_dir, n: int = 1):
    """Each vector beside that of the next id."""
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - n).alias("vec_id"), F.col("embedding").alias("other"))
    return e.select("vec_id", "embedding").join(b, "vec_id")


PAIRS = "SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query("N1", "SELECT vec_id, round(list_sum(list_transform(n, lambda x: x * x)), 6) + 0.0 AS norm2, round(n[1], 6) + 0.0 AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-8)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))")
def n1(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize("embedding").alias("v"))
    return v.select("vec_id", (F.round(vectors.dot("v", "v"), 6) + 0.0).alias("norm2"), (F.round(F.element_at("v", 1), 6) + 0.0).alias("first"))


def _pairwise(name, column, sql):
    @query(name, f"SELECT vec_id, round({sql}, 6) + 0.0 AS value FROM ({PAIRS})")
    def run(spark, sf_dir):
        return pairs(spark, sf_dir).select("vec_id", (F.round(column("embedding", "other"), 6) + 0.0).alias("value"))


_pairwise("N2", vectors.cosine_similarity, "list_cosine_similarity(a, b)")
_pairwise("N3", vectors.cosine_distance, "1 - list_cosine_similarity(a, b)")
_pairwise("N4", vectors.euclidean_distance, "list_distance(a, b)")
ABS = "list_transform(list_zip(list_transform(a, lambda x: abs(x)), list_transform(b, lambda x: abs(x))), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / (z[1] + z[2] + 1e-10))"
_absolute = lambda f: lambda a, b: f(F.transform(vectors.as_double(a), F.abs), F.transform(vectors.as_double(b), F.abs))
_pairwise("N5", _absolute(vectors.chi2_distance), f"list_sum({ABS})")
_pairwise("N6", _absolute(vectors.chi2_similarity), f"1 / (1 + list_sum({ABS}))")


@query("N7", "SELECT label, vec_id, round((s - min(s) OVER w) / CASE WHEN max(s) OVER w > min(s) OVER w THEN max(s) OVER w - min(s) OVER w ELSE 1 END, 6) + 0.0 AS score FROM (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS s FROM embeddings) WINDOW w AS (PARTITION BY label)")
def n7(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.element_at("embedding", 1).cast("double").alias("score"))
    return vectors.minmax_normalize(s, "label").withColumn("score", F.round("score", 6) + 0.0)


@query("N8", "SELECT label, vec_id, round(1 - d / (max(d) OVER (PARTITION BY label) + 1e-8), 6) + 0.0 AS score FROM (SELECT label, vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS d FROM embeddings)")
def n8(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.abs(F.element_at("embedding", 1).cast("double")).alias("distance"))
    return vectors.distance_to_similarity(d, "label").select("label", "vec_id", (F.round("score", 6) + 0.0).alias("score"))


RGB = "SELECT p_partkey, CAST(p_partkey * 7 % 256 AS DOUBLE) AS r, CAST(p_partkey * 13 % 256 AS DOUBLE) AS g, CAST(p_partkey * 29 % 256 AS DOUBLE) AS b FROM part"
_lin = lambda c: f"CASE WHEN {c}/255e0 > 0.04045e0 THEN pow(({c}/255e0 + 0.055e0) / 1.055e0, 2.4e0) ELSE {c}/255e0/12.92e0 END"
_mix = lambda k, v: " + ".join(f"{x}e0 * {c}" for x, c in zip(k, v))
_f = lambda t: f"CASE WHEN {t} > 0.008856e0 THEN pow({t}, 1e0/3) ELSE 7.787e0 * {t} + 16e0/116 END"
_grid = lambda c: f"least(greatest(floor({c} + 0.5e0), 0e0), 255e0)"
LAB = f"""SELECT p_partkey, {_grid("(CASE WHEN y > 0.008856e0 THEN 116 * fy - 16 ELSE 903.3e0 * y END) * 255e0 / 100")} * 100e0 / 255 AS l,
 {_grid("500 * (fx - fy) + 128")} - 128e0 AS a, {_grid("200 * (fy - fz) + 128")} - 128e0 AS b FROM (
 SELECT *, {_f("x")} AS fx, {_f("y")} AS fy, {_f("z")} AS fz FROM (
 SELECT p_partkey, {", ".join(f"({_mix(k, ('lr', 'lg', 'lb'))}) / {w}e0 AS {n}" for k, w, n in zip(colors.TO_XYZ, colors.WHITE, "xyz"))} FROM (
 SELECT p_partkey, {_lin("r")} AS lr, {_lin("g")} AS lg, {_lin("b")} AS lb FROM ({RGB}))))"""


def rgb(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", *((k * m % 256).cast("double").alias(c) for c, m in (("r", 7), ("g", 13), ("b", 29))))


def lab(spark, sf_dir):
    return rgb(spark, sf_dir).select("p_partkey", *(c.alias(n) for c, n in zip(colors.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")), "lab")))


@query("N9", f"SELECT p_partkey, round(l, 6) + 0.0 AS l, a + 0.0 AS a, b + 0.0 AS b FROM ({LAB})")
def n9(spark, sf_dir):
    return lab(spark, sf_dir).select("p_partkey", (F.round("l", 6) + 0.0).alias("l"), (F.col("a") + 0.0).alias("a"), (F.col("b") + 0.0).alias("b"))


_inv = lambda f, w: f"{w}e0 * (CASE WHEN {f} > 6e0/29 THEN {f} * {f} * {f} ELSE ({f} - 16e0/116) / 7.787e0 END)"
_gam = lambda c: f"floor((CASE WHEN {c} > 0.0031308e0 THEN 1.055e0 * pow({c}, 1/2.4e0) - 0.055e0 ELSE 12.92e0 * {c} END) * 255 + 0.5e0)"
BACK = f"""SELECT p_partkey, {", ".join(f"{_gam('c' + n)} AS {n}" for n in "rgb")} FROM (SELECT p_partkey, {", ".join(f"least(greatest({_mix(k, 'xyz')}, 0e0), 1e0) AS c{n}" for k, n in zip(colors.FROM_XYZ, "rgb"))} FROM (
 SELECT p_partkey, {_inv("((l + 16) / 116 + a / 500)", colors.WHITE[0])} AS x, {_inv("((l + 16) / 116)", colors.WHITE[1])} AS y, {_inv("((l + 16) / 116 - b / 200)", colors.WHITE[2])} AS z FROM ({LAB})))"""


@query("N10", BACK)
def n10(spark, sf_dir):
    return lab(spark, sf_dir).select("p_partkey", *(c.alias(n) for c, n in zip(colors.lab_to_rgb(F.col("l"), F.col("a"), F.col("b")), "rgb")))


@query("N11", f"SELECT p_partkey, round(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 6) AS gray FROM ({RGB})")
def n11(spark, sf_dir):
    return rgb(spark, sf_dir).select("p_partkey", F.round(colors.gray(F.col("r"), F.col("g"), F.col("b")), 6).alias("gray"))


SLUG = lambda c, n: f"CASE WHEN trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-') = '' THEN 'text' ELSE substr(trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), 1, {n}) END"


@query("F1", f"SELECT doc_id, {SLUG('text', 40)} AS slug FROM documents")
def f1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.slugify(F.col("text")).alias("slug"))


@query("F2", f"SELECT doc_id, printf('%02d_', doc_id % 100) || substr(md5(source), 1, 8) || '_' || {SLUG('text', 36)} || '_poetry.jpg' AS name FROM documents")
def f2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.short_name(F.col("source"), F.col("text"), F.col("doc_id") % 100).alias("name"))


@query("F3", r"SELECT page_id, list_last(string_split(url, '/')) AS base, lower(regexp_extract(list_last(string_split(url, '/')), '(\.[^.]+)$', 1)) AS ext, regexp_replace(list_last(string_split(url, '/')), '\.[^.]+$', '') AS stem, starts_with(url, '/') AS absolute, CASE WHEN starts_with(url, '/') THEN url ELSE '/data/' || url END AS resolved FROM pages")
def f3(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", strings.basename(u).alias("base"), strings.extension(u).alias("ext"), strings.stem(u).alias("stem"), strings.is_absolute(u).alias("absolute"), strings.resolve(u, "/data").alias("resolved"))


@query("F4", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS scene, line FROM (SELECT doc_id, trim(unnest(l)) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''")
def f4(spark, sf_dir):
    return strings.scenes(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("F5", "SELECT doc_id, md5('v1|' || source || '|' || n_chars) AS key FROM documents")
def f5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.cache_key("v1", F.col("source"), F.col("n_chars")).alias("key"))
