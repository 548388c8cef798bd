"""Human-readable reasons for ranking decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import dicts
from bidlens.operators.analytics import top_per_group


def factor_reasons(factors: DataFrame, texts: DataFrame) -> DataFrame:
    """Message per factor row; ``texts(factor, filled, plain)``, rows have category and count.

    The filled text is used if every placeholder in it has a value.
    """
    usable = (
        F.col("filled").isNotNull()
        & (~F.contains("filled", F.lit("{category}")) | (F.coalesce("category", F.lit("")) != ""))
        & (~F.contains("filled", F.lit("{count}")) | (F.coalesce("count", F.lit(0)) > 0))
    )
    filled = F.replace(
        F.replace("filled", F.lit("{category}"), F.coalesce("category", F.lit(""))),
        F.lit("{count}"), F.coalesce(F.col("count").cast("string"), F.lit("")),
    )
    return factors.join(texts, "factor", "left").withColumn(
        "reason", F.when(usable, filled).otherwise(F.coalesce("plain", "factor"))
    ).drop("filled", "plain")


def rule_explain() -> Column:
    """Texts of all features above one half, without repetition."""
    return F.array_distinct(F.array_compact(F.array(
        *[F.when(F.col(f) > 0.5, text) for f, text in dicts.FEATURE_TEXTS]
    )))


def top_contributions(features: DataFrame, weights: list[float] = dicts.FEATURE_WEIGHTS, k: int = 3) -> DataFrame:
    """The ``k`` largest contributions of the linear model per result, with their sign."""
    texts = dict(dicts.FEATURE_TEXTS)
    parts = F.array(*[
        F.struct(
            (-F.abs(F.round(F.col(f) * w, 8))).alias("size"), F.lit(n).alias("n"), F.lit(f).alias("feature"),
            F.round(F.col(f) * w, 8).alias("value"), F.lit(texts[f]).alias("text"),
        )
        for n, (f, w) in enumerate(zip(dicts.FEATURES, weights))
    ])
    return features.select(
        "request_id", "item_id", F.posexplode(F.slice(F.array_sort(parts), 1, k)).alias("pos", "p")
    ).select(
        "request_id", "item_id", (F.col("pos") + 1).alias("position"), F.col("p.feature").alias("feature"),
        F.col("p.value").alias("contribution"),
        F.concat(F.when(F.col("p.value") > 0, "+ ").otherwise("- "), "p.text").alias("explanation"),
    )


def explanation_totals(cands: DataFrame) -> DataFrame:
    add = lambda keep: F.aggregate(F.filter("explanations", keep), F.lit(0.0), lambda s, e: s + e["weight"])
    peak = F.aggregate(
        "explanations", F.lit(1.0), lambda m, e: F.greatest(m, F.abs(e["weight"]))
    )
    return cands.select(
        "request_id", "item_id",
        F.round(add(lambda e: e["weight"] > 0), 6).alias("positive"),
        F.round(add(lambda e: e["weight"] < 0), 6).alias("negative"),
        F.round(add(lambda e: e["weight"] != 0), 6).alias("total"),
        F.round(peak, 6).alias("max_weight"),
    )


def score_breakdown(hits: DataFrame) -> DataFrame:
    """Factor rows of (query, item): text match, trigram similarity, popularity."""
    factor = lambda name, score, kind: F.struct(F.lit(name).alias("factor"), score.cast("double").alias("score"), F.lit(kind).alias("type"))
    return hits.select("query", "item_id", F.explode(F.array(
        factor("Совпадение по tsvector", F.round("ts_score", 4), "text"),
        factor("Триграмное сходство", F.round("similarity", 4), "text"),
        factor("Популярность (кол-во контрактов)", F.col("contract_cnt"), "popularity"),
    )).alias("f")).select("query", "item_id", "f.factor", "f.score", "f.type")
