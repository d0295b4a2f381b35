"""Vectors as column expressions and as grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """a at length one; a zero vector stays."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)), F.lit(0))


def vector_sums(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, vec_sum and n: additive, so that sums of parts can be added."""
    parts = rows.select(key, F.posexplode(F.col(vector)).alias("pos", "x"))
    sums = parts.groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return sums.groupBy(key).agg(F.transform(ordered, lambda s: s["x"]).alias("vec_sum"), F.max("n").alias("n"))


def centroids(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, centroid (unit length) and n."""
    return vector_sums(rows, key, vector).select(key, unit(F.col("vec_sum")).alias("centroid"), "n")
