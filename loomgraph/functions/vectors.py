"""Vectors as array columns: norms, cosine, padding, pooling, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def fit_dim(a: Column, n: int) -> Column:
    """Cut or padded with zeros to n."""
    return F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), n)), 1, n)


def wide(df: DataFrame, vector: str, prefix: str, n: int) -> DataFrame:
    """The vector's elements as columns prefix_0 ... prefix_{n-1}."""
    return df.select(*[c for c in df.columns if c != vector], *[F.col(vector)[i].alias(f"{prefix}_{i}") for i in range(n)])


def narrow(df: DataFrame, prefix: str, vector: str) -> DataFrame:
    """Columns prefix_i gathered in numeric order into one array."""
    own = sorted((c for c in df.columns if c.startswith(prefix + "_") and c[len(prefix) + 1 :].isdigit()), key=lambda c: int(c[len(prefix) + 1 :]))
    return df.select(*[c for c in df.columns if c not in own], F.array(*map(F.col, own)).alias(vector))


def elements(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """keys, pos, x: one row per element."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def packed(df: DataFrame, *keys: str, value: str = "x", name: str = "vector") -> DataFrame:
    """The rows of ``elements`` as vectors again."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias(name))


def pooled(df: DataFrame, vector: str, weight: Column, *keys: str) -> DataFrame:
    """keys, pos, x: weighted means of vectors per key and element, combined before the shuffle."""
    rows = df.select(*keys, weight.cast("double").alias("w"), F.posexplode(vector).alias("pos", "v"))
    return rows.groupBy(*keys, "pos").agg((F.sum(F.col("w") * F.col("v").cast("double")) / F.sum("w")).alias("x"))


def zscored(df: DataFrame, vector: str, train: Column, *keys: str) -> DataFrame:
    """keys, pos, x: elements scaled by mean and population deviation of the training rows; a deviation under 1e-8 counts as 1.

    The statistics are a row per element, so they are broadcast whatever the number of rows.
    """
    rows = df.select(*keys, train.alias("train"), F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    stats = rows.where("train").groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scaled = (F.col("v") - F.col("m")) / F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s"))
    return rows.join(F.broadcast(stats), "pos").select(*keys, "pos", scaled.alias("x"))
