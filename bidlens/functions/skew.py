"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], salts: int = SALTS, how: str = "inner"
) -> DataFrame:
    """Join on ``keys`` with the rows of one key spread over ``salts`` tasks.

    ``big`` rows are spread by a hash of ``spread_by``; ``small`` is repeated once per salt, so
    every pair still meets exactly once. ``how`` may be inner, left, left_semi or left_anti.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def hot_salted_join(
    big: DataFrame, small: DataFrame, key: str, spread_by: list[str], is_hot: Column, salts: int = SALTS
) -> DataFrame:
    """Inner join on ``key`` that spreads only the keys ``is_hot`` marks in ``small``.

    ``small`` has one row per key. The hot keys are broadcast to mark the rows of ``big``, so the
    condition must bound their number whatever the size of the data.
    """
    hot = F.broadcast(small.where(is_hot).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(0).cast("int")
    left = big.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(small.withColumn("_salt", F.explode(copies)), [key, "_salt"]).drop("_salt")
