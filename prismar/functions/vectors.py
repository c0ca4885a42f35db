"""Vector functions as column expressions over array columns; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def half_up(x: Column, digits: int) -> Column:
    """`x` times 10^digits to the nearest whole number in doubles, halves away from zero, as the SQL that results are held against rounds. Spark's round() takes the
    shortest decimal form of `x` instead, and differs where the product falls on the other side of a half."""
    y = F.abs(x) * 10.0**digits
    whole = F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1.0).otherwise(0.0)
    return F.when(y < 2.0**52, F.signum(x) * whole / 10.0**digits).otherwise(x)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(as_double(v), lambda x: x * x)))


def l2_normalize(v: Column | str) -> Column:
    n = norm(v) + 1e-8
    return F.transform(as_double(v), lambda x: x / n)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """0 where a norm is 0."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine_similarity(a, b)


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def chi2_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y) / (x + y + 1e-10)))


def chi2_similarity(a: Column | str, b: Column | str) -> Column:
    return 1 / (1 + chi2_distance(a, b))


def minmax_normalize(scores: DataFrame, *by: str) -> DataFrame:
    """score -> (score - min) / (max - min) in each group; a group of equal scores divides by 1."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("score", (F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0))


def distance_to_similarity(distances: DataFrame, *by: str) -> DataFrame:
    """score = 1 - distance / (greatest distance of the group + 1e-8), over all candidates of the group."""
    return distances.withColumn("score", 1 - F.col("distance") / (F.max("distance").over(Window.partitionBy(*by)) + 1e-8))
