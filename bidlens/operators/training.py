"""Learning-to-rank training data from purchases, and rankers fitted on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import dicts
from bidlens.functions.vectors import dot
from bidlens.operators import personal as P
from bidlens.operators.analytics import top_per_group

CAP = 400  # candidates per training group, retrieved ones first


def digest(*cols: str | Column) -> Column:
    """Reproducible pseudo-random order, independent of partitioning."""
    return F.md5(F.concat_ws("|", *cols))


def training_users(facts: DataFrame, catalog: DataFrame, min_items: int = 3) -> DataFrame:
    """Users with at least three distinct items, from counted purchases."""
    known = facts.join(catalog.select("item_id"), "item_id", "left_semi")
    return known.groupBy("user_id").agg(
        F.count("*").alias("n_items"), F.sum("times").alias("n_contracts")
    ).where(F.col("n_items") >= min_items)


def training_queries(
    users: DataFrame, facts: DataFrame, catalog: DataFrame, max_users: int = 1000, per_user: int = 5
) -> DataFrame:
    """Sample of users and of their purchased items; the item's name is the query."""
    chosen = users.select("user_id", digest("user_id").alias("h")).orderBy("h", "user_id").limit(max_users)
    bought = facts.join(chosen.select("user_id"), "user_id", "left_semi").select("user_id", "item_id")
    picked = top_per_group(
        bought.withColumn("h", digest("user_id", "item_id")), "user_id", ["h", "item_id"], per_user
    )
    named = catalog.select("item_id", F.lower("name").alias("query"), F.col("category").alias("query_category"))
    return (
        picked.join(named, "item_id")
        .where("query is not null and query <> ''")
        .select(
            F.concat_ws("-", "user_id", "item_id").alias("group_id"), "user_id", F.col("item_id").alias("query_item"),
            "query", "query_category",
        )
    )


def training_candidates(
    queries: DataFrame, bm25_top: DataFrame, vector_top: DataFrame, facts: DataFrame, cap: int = CAP
) -> DataFrame:
    """Top BM25, top vector and purchased items per group, at most 400, retrieved ones first.

    ``bm25_top(query, item_id)`` is per distinct name, ``vector_top(query_item, item_id)`` per item.
    """
    keys = ["group_id", "user_id", "query_item"]
    lexical = queries.select(*keys, "query").join(bm25_top.select("query", "item_id"), "query").drop("query")
    semantic = queries.select(*keys).join(vector_top.select("query_item", "item_id"), "query_item").select(*keys, "item_id")
    # at most ``cap`` purchases of a user can be kept, so the others need not be joined
    own = facts.join(queries.select("user_id").distinct(), "user_id", "left_semi").select(
        "user_id", "item_id", digest("user_id", "item_id").alias("h")
    )
    own = top_per_group(own, "user_id", ["h", "item_id"], cap).drop("rn")
    bought = queries.select(*keys).join(own.select("user_id", "item_id"), "user_id").select(*keys, "item_id")
    merged = (
        lexical.withColumn("late", F.lit(0)).unionByName(semantic.withColumn("late", F.lit(0)))
        .unionByName(bought.withColumn("late", F.lit(1)))
        .groupBy(*keys, "item_id")
        .agg(F.min("late").alias("late"))
        .withColumn("h", digest("user_id", "item_id"))
    )
    return top_per_group(merged, "group_id", ["late", "h", "item_id"], cap).select(*keys, "item_id", "rn")


def graded_labels(cands: DataFrame, queries: DataFrame, catalog: DataFrame, facts: DataFrame, categories: DataFrame) -> DataFrame:
    """4 the item itself, 3 purchased, 2 same category, 1 a category of the user, else 0."""
    bought = facts.select("user_id", "item_id", F.lit(True).alias("bought"))
    mine = categories.select("user_id", "category", F.lit(True).alias("mine"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        cands.join(queries.select("group_id", "query", "query_category"), "group_id")
        .join(catalog.select("item_id", "category", "name"), "item_id")
        .join(bought, ["user_id", "item_id"], "left")
        .join(mine, ["user_id", "category"], "left")
        .withColumn(
            "relevance",
            F.when(F.col("item_id") == F.col("query_item"), 4).when(yes("bought"), 3)
            .when((F.col("category") == F.col("query_category")) & (F.col("category") != ""), 2)
            .when(yes("mine"), 1).otherwise(0),
        )
        .drop("bought", "mine")
    )


def training_pairs(
    labelled: DataFrame, users: DataFrame, weights: DataFrame, profile_vectors: DataFrame, item_vectors: DataFrame,
    bm25_full: DataFrame, popularity: DataFrame, min_size: int = 3,
) -> DataFrame:
    """Features and label per (group, item); purchase and session features are zero (no leakage).

    ``bm25_full(query, name, score)`` is normalised; ``popularity(item_id, pop)`` is a share.
    """
    sizes = labelled.groupBy("group_id").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    qv = item_vectors.select(F.col("item_id").alias("query_item"), F.col("vector").alias("qv"))
    j = (
        labelled.join(sizes, "group_id", "left_semi")
        .join(bm25_full.select("query", "name", F.col("score").alias("bm25")), ["query", "name"], "left")
        .join(weights.select("user_id", "category", "weight"), ["user_id", "category"], "left")
        .join(profile_vectors.withColumnRenamed("vector", "pv"), "user_id", "left")
        .join(item_vectors.withColumnRenamed("vector", "iv"), "item_id", "left")
        .join(qv, "query_item", "left")
        .join(users.select("user_id", "n_items"), "user_id")
        .join(popularity, "item_id", "left")
    )
    none = F.lit(0.0)
    return j.select(
        "group_id", "item_id", "relevance",
        zero(F.col("bm25")).alias("bm25_score"),
        F.round(zero(dot(F.col("qv"), F.col("iv"))), 6).alias("semantic_score"),
        F.col("weight").isNotNull().cast("double").alias("category_match"),
        F.round(zero(F.col("weight")), 6).alias("category_weight"),
        F.round(zero(dot(F.col("pv"), F.col("iv"))), 6).alias("profile_similarity"),
        F.round(F.least(zero(F.col("pop")), F.lit(1.0)), 6).alias("popularity_score"),
        F.least(F.length("name") / 100.0, F.lit(1.0)).alias("name_length"),
        none.alias("is_previously_purchased"), none.alias("is_negative_signal"),
        F.least(F.col("n_items") / 100.0, F.lit(1.0)).alias("total_user_contracts"),
        none.alias("session_click_count"),
    )


def count_popularity(facts: DataFrame) -> DataFrame:
    """Contract count of an item divided by the largest count."""
    counts = facts.groupBy("item_id").agg(F.sum("times").alias("n"))
    return counts.select("item_id", (F.col("n") / counts.select(F.max("n")).scalar()).alias("pop"))


def group_split(pairs: DataFrame, validation_percent: int = 20) -> DataFrame:
    """Adds ``split``: whole groups go to train or validation."""
    bucket = F.conv(F.substring(F.md5("group_id"), 1, 8), 16, 10).cast("long") % 100
    return pairs.withColumn("split", F.when(bucket < validation_percent, "validation").otherwise("train"))


def label_distribution(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("relevance").agg(F.count("*").alias("samples"))


# ---- models --------------------------------------------------------------------------------
def _assemble(pairs: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=dicts.FEATURES, outputCol="features").transform(pairs)


def train_tree_ranker(pairs: DataFrame, depth: int = 5, iterations: int = 10):
    """Gradient-boosted trees on the graded labels (pointwise)."""
    from pyspark.ml.regression import GBTRegressor

    gbt = GBTRegressor(featuresCol="features", labelCol="relevance", maxDepth=depth, maxIter=iterations, stepSize=0.3, seed=42)
    return gbt.fit(_assemble(pairs))


def tree_score(model, pairs: DataFrame) -> DataFrame:
    return model.transform(_assemble(pairs)).drop("features").withColumnRenamed("prediction", "model_score")


def preference_pairs(pairs: DataFrame, per_item: int = 5) -> DataFrame:
    """Feature differences of better and worse items of the same group.

    Each item meets the ``per_item`` items that follow it in a reproducible order of its group and
    have another label, so a group gives a number of rows proportional to its size.
    """
    order = W.partitionBy("group_id").orderBy(digest("group_id", "item_id"))
    rows = pairs.select("group_id", "relevance", F.array(*dicts.FEATURES).alias("x"), "item_id")
    ahead = F.array(*[F.lead(F.struct("relevance", "x"), n).over(order) for n in range(1, per_item + 1)])
    met = rows.withColumn("ahead", ahead).withColumn("o", F.explode("ahead")).where("o is not null and o.relevance <> relevance")
    sign = F.when(F.col("relevance") > F.col("o.relevance"), 1.0).otherwise(-1.0)
    return met.select(
        "group_id", F.zip_with("x", "o.x", lambda a, b: a - b).alias("diff"), sign.alias("better")
    )


def train_pairwise_ranker(pairs: DataFrame):
    """Weights of a pairwise ranker: logistic regression without intercept on differences."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    diffs = preference_pairs(pairs).select(
        array_to_vector("diff").alias("features"), (F.col("better") > 0).cast("double").alias("label")
    )
    model = LogisticRegression(fitIntercept=False, standardization=True, regParam=1e-4, maxIter=30).fit(diffs)
    return [float(w) for w in model.coefficients]


def pairwise_score(weights: list[float], pairs: DataFrame) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(f) * w for f, w in zip(dicts.FEATURES, weights)])
    return pairs.withColumn("model_score", total)


def as_judged(scored: DataFrame, run: str) -> DataFrame:
    """Result lists of a scored pair table, for the metrics."""
    return top_per_group(scored, "group_id", [F.desc("model_score"), "item_id"], CAP).select(
        F.lit(run).alias("run"), F.col("group_id").alias("query_id"), F.col("rn").alias("rank"), F.col("relevance").alias("rel")
    )
