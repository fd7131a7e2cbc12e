"""Vectors in arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_embedding(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Normalised mean of normalised vectors: by, vector."""
    unit = F.transform(vector, lambda v: v.cast("double") / norm(F.col(vector)))
    parts = df.select(by, F.posexplode(unit).alias("i", "v")).groupBy(by, "i").agg(F.avg("v").alias("v"))
    out = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m"))
    return out.select(by, F.transform("m", lambda v: v / norm(F.col("m"))).alias(vector))


def softmax(df: DataFrame, by: str, score: str, temperature: float, into: str = "p") -> DataFrame:
    """exp(temperature x score) as a share of its group, shifted by the maximum."""
    w = Window.partitionBy(by)
    e = F.exp(F.lit(temperature) * (F.col(score) - F.max(score).over(w)))
    return df.withColumn("_e", e).withColumn(into, F.col("_e") / F.sum("_e").over(w)).drop("_e")
