"""Vector column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: x / F.greatest(size, F.lit(1e-9)))


def centroid(df: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """Unit-length mean vector per key; partial sums are merged, no group is collected."""
    means = (
        df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    )
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms"))
    return packed.select(*keys, unit(F.col("ms.m")).alias(out))
