"""Supplier and buyer analytics: prices, popularity, hot items, product and query reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TREND_THRESHOLD = 0.10
RECENT_DAYS = 180
HOT_DAYS = 30


def latest(df: DataFrame, column: str) -> Column:
    """Newest value of a column as an uncorrelated scalar subquery."""
    return df.select(F.max(column)).scalar()


def price_trend(overall: Column, recent: Column) -> Column:
    change = (recent - overall) / overall
    return (
        F.when(change > TREND_THRESHOLD, "up").when(change < -TREND_THRESHOLD, "down").otherwise("stable")
    )


def _price_stats(contracts: DataFrame, as_of: Column) -> DataFrame:
    recent = F.col("contract_date") >= F.date_sub(as_of, RECENT_DAYS)
    return (
        contracts.where(F.col("cost") > 0)
        .groupBy("item_id")
        .agg(
            F.avg("cost").alias("avg_all"),
            F.min("cost").alias("min_all"),
            F.max("cost").alias("max_all"),
            F.avg(F.when(recent, F.col("cost"))).alias("avg_recent"),
            F.count("*").alias("total_cnt"),
            F.count_if(recent).alias("recent_cnt"),
        )
        .withColumn("price_trend", price_trend(F.col("avg_all").cast("double"), F.col("avg_recent").cast("double")))
    )


def price_info(contracts: DataFrame, as_of: Column) -> DataFrame:
    """Average price and trend of items with at least two priced contracts."""
    return (
        _price_stats(contracts, as_of)
        .where("total_cnt >= 2")
        .select("item_id", F.round("avg_all", 2).cast("double").alias("avg_price"), "price_trend")
    )


def price_benchmark(catalog: DataFrame, contracts: DataFrame, as_of: Column) -> DataFrame:
    """Price statistics of every catalogue item, nulls where nothing was sold."""
    money = lambda c, n: F.round(c, 2).cast("double").alias(n)
    return (
        catalog.select("item_id", "name")
        .join(_price_stats(contracts, as_of), "item_id", "left")
        .select(
            "item_id", "name",
            money("avg_all", "avg_price"), money("min_all", "min_price"), money("max_all", "max_price"),
            money("avg_recent", "recent_avg"),
            F.coalesce("price_trend", F.lit("stable")).alias("price_trend"),
            F.coalesce("total_cnt", F.lit(0)).alias("contract_count"),
            F.coalesce("recent_cnt", F.lit(0)).alias("recent_count"),
        )
    )


def hot_items(
    catalog: DataFrame, contracts: DataFrame, events: DataFrame, as_of: Column, top: int = 10
) -> DataFrame:
    """Items with the most contracts in the last 30 days, their views and a price-drop flag."""
    recent = (
        contracts.where(F.col("contract_date") >= F.date_sub(as_of, HOT_DAYS))
        .groupBy("item_id")
        .agg(F.count("*").alias("recent_contracts"))
        .orderBy(F.desc("recent_contracts"), "item_id")
        .limit(top)
    )
    views = events.where("event_type = 'view'").groupBy("item_id").agg(F.count("*").alias("recent_views"))
    half_year = F.col("contract_date") >= F.date_sub(as_of, RECENT_DAYS)
    prices = (
        contracts.where("cost > 0")
        .join(recent.select("item_id"), "item_id", "left_semi")
        .groupBy("item_id")
        .agg(
            F.avg(F.when(half_year, F.col("cost"))).cast("double").alias("recent_avg"),
            F.avg("cost").cast("double").alias("all_avg"),
        )
    )
    views_n = F.coalesce("recent_views", F.lit(0))
    return (
        recent.join(catalog.select("item_id", "name", "category"), "item_id")
        .join(views, "item_id", "left")
        .join(prices, "item_id", "left")
        .select(
            "item_id", "name", "category",
            F.round(F.col("recent_contracts") + views_n * 0.1, 2).alias("hot_score"),
            views_n.alias("recent_views"), "recent_contracts",
            F.coalesce(F.col("recent_avg") < F.col("all_avg") * 0.9, F.lit(False)).alias("price_drop"),
        )
    )


def _query_counts(events: DataFrame, key: str) -> DataFrame:
    asked = events.where("query is not null and query <> ''")
    return asked.groupBy(key, "query").agg(F.count("*").alias("cnt"))


def numbered(df: DataFrame, group: str, order: list) -> DataFrame:
    """All rows with their place ``rn`` in the group."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """First ``k`` rows per group; Spark cuts each map task to ``k`` rows before the shuffle."""
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def product_analytics(
    catalog: DataFrame, contracts: DataFrame, events: DataFrame, as_of: Column
) -> DataFrame:
    """Event counters by type, ten top queries, price and orders of every product."""
    kinds = [("view", "total_views"), ("click", "total_clicks"), ("like", "total_likes"),
             ("dislike", "total_dislikes"), ("compare", "total_compares")]
    counters = events.groupBy("item_id").agg(
        *[F.count_if(F.col("event_type") == k).alias(n) for k, n in kinds]
    )
    tops = (
        top_per_group(_query_counts(events, "item_id"), "item_id", [F.desc("cnt"), "query"], 10)
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "query"))).alias("q"))
        .select("item_id", F.col("q.query").alias("top_search_queries"))
    )
    joined = (
        catalog.select("item_id", "name", "order_count")
        .join(counters, "item_id", "left")
        .join(tops, "item_id", "left")
        .join(price_info(contracts, as_of), "item_id", "left")
    )
    return joined.select(
        "item_id", "name",
        *[F.coalesce(n, F.lit(0)).alias(n) for _, n in kinds],
        F.coalesce("top_search_queries", F.array().cast("array<string>")).alias("top_search_queries"),
        "avg_price", "price_trend", "order_count",
    )


def supplier_top_queries(catalog: DataFrame, events: DataFrame, top: int = 20) -> DataFrame:
    """Queries that led to a supplier's items, the 20 most frequent per supplier."""
    per_item = _query_counts(events, "item_id")  # small before the join
    per_supplier = (
        per_item.join(catalog.select("item_id", "creator_user_id"), "item_id")
        .where("creator_user_id is not null")
        .groupBy("creator_user_id", "query")
        .agg(F.sum("cnt").alias("impressions"))
    )
    return top_per_group(
        per_supplier, "creator_user_id", [F.desc("impressions"), "query"], top
    ).select(F.col("creator_user_id").alias("user_id"), "query", "impressions", F.col("rn").alias("position"))


def item_popularity(facts: DataFrame) -> DataFrame:
    """Blend of contract count, volume and distinct customers, each divided by its maximum.

    ``facts`` hold one row per (user, item), so distinct customers are plain row counts.
    """
    return popularity_of(item_totals(facts))


def item_totals(facts: DataFrame) -> DataFrame:
    return facts.groupBy("item_id").agg(
        F.sum("times").alias("contract_count"),
        F.sum("volume").alias("total_volume"),
        F.count("*").alias("unique_customers"),
    )


def popularity_of(per_item: DataFrame) -> DataFrame:
    """``item_popularity`` from ``item_totals``, which are read twice."""
    fields = ("contract_count", "total_volume", "unique_customers")
    peaks = per_item.agg(  # one subquery for all three maxima
        F.struct(*[F.greatest(F.max(c).cast("double"), F.lit(1e-9)).alias(c) for c in fields]).alias("p")
    ).scalar()
    norm = lambda c: F.col(c).cast("double") / peaks[c]
    score = 0.4 * norm("contract_count") + 0.3 * norm("total_volume") + 0.3 * norm("unique_customers")
    return per_item.select(
        "item_id", "contract_count", F.col("total_volume").cast("double").alias("total_volume"),
        "unique_customers",
        F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 6).alias("popularity_score"),
    )


def popularity_stats(popularity: DataFrame) -> DataFrame:
    """Mean, median and 90th percentile (both exact, from value counts)."""
    return popularity.agg(
        F.count("*").alias("items"),
        F.round(F.avg("popularity_score"), 4).alias("mean"),
        F.round(F.percentile("popularity_score", F.lit(0.5)), 4).alias("median"),
        F.round(F.percentile("popularity_score", F.lit(0.9)), 4).alias("p90"),
    )


def category_counts(catalog: DataFrame) -> DataFrame:
    return (
        catalog.where("category is not null").groupBy("category").agg(F.count("*").alias("cnt"))
    )
