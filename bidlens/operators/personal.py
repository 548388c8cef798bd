"""Personalisation of request candidates.

Every factor is a small aggregated table joined to the candidate rows, so a (request, item) row
carries all of its factors and is shuffled once per key, whatever the number of factors.
Candidates have request_id, user_id, session_id, interests, item_id, name, category.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions.skew import salted_join
from bidlens.functions.text import short_substrings
from bidlens.functions.vectors import dot, norm
from bidlens.operators.analytics import top_per_group

HALF_LIFE_DAYS = 14
BOOST, NEGATIVE = 0.3, 0.8
AFFINITY = 0.3
HEAVY_BUYER = 1000  # distinct items from which a neighbour is looked up, not listed


# ---- history -----------------------------------------------------------------------------
def items_of(facts: DataFrame, users: DataFrame) -> DataFrame:
    """Purchase counts (user_id, item_id, times, last_date) of the given users only."""
    return facts.join(users.select("user_id").distinct(), "user_id", "left_semi")


def user_categories(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user, category, contracts) from the already counted purchases."""
    return (
        items.join(catalog.where("category is not null").select("item_id", "category"), "item_id")
        .groupBy("user_id", "category")
        .agg(F.sum("times").alias("cnt"))
    )


def history_boost(cands: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``history``: bought before."""
    bought = items.select("user_id", "item_id", "times")
    return cands.join(bought, ["user_id", "item_id"], "left").withColumn("history", history_weight())


def history_weight() -> Column:
    return F.when(F.col("times") > 0, F.round(F.least(0.5 + F.col("times") * 0.1, F.lit(1.0)), 6))


def category_affinity(cands: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds ``affinity``: the category is one of the user's five most purchased."""
    marks = top_categories(categories).select("user_id", "category", F.lit(AFFINITY).alias("affinity"))
    return cands.join(marks, ["user_id", "category"], "left")


def top_categories(categories: DataFrame) -> DataFrame:
    return top_per_group(categories, "user_id", [F.desc("cnt"), "category"], 5).select("user_id", "category")


# ---- interests ---------------------------------------------------------------------------
def effective_interests(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Interests of the profile, else its industry, else those of the request."""
    known = profiles.select("user_id", F.col("interests").alias("own"), "industry")
    filled = lambda a: F.when(F.size(a) > 0, a)
    return (
        requests.select("request_id", "user_id", "interests")
        .join(known, "user_id", "left")
        .select(
            "request_id", "user_id",
            F.coalesce(
                filled(F.coalesce("own", F.when(F.col("industry").isNotNull(), F.array("industry")))),
                filled(F.array_compact("interests")),
            ).alias("likes"),
        )
        .where("likes is not null")
    )


def interest_categories(
    likes: DataFrame, industry_categories: DataFrame, universal: DataFrame, domain: DataFrame
) -> DataFrame:
    """Wanted and penalised categories of every distinct list of interests.

    The dimension tables are small; requests meet the result on their list of interests.
    """
    lists = likes.select("likes").distinct()
    one = lists.select("likes", F.explode("likes").alias("industry"))
    wanted = (
        one.join(industry_categories, "industry", "left")
        .select("likes", F.coalesce("category", "industry").alias("category"))
        .groupBy("likes")
        .agg(F.collect_set("category").alias("wanted"))
    )
    owned = one.join(domain, "industry").groupBy("likes").agg(F.collect_set("category").alias("owned"))
    common = universal.select(F.collect_set("category")).scalar()
    specific = domain.select(F.collect_set("category")).scalar()
    none = F.array().cast("array<string>")
    fine = F.concat("wanted", common, F.coalesce("owned", none))
    return wanted.join(owned, "likes", "left").select("likes", "wanted", F.array_except(specific, fine).alias("penalised"))


def with_interests(cands: DataFrame, likes: DataFrame, lists: DataFrame) -> DataFrame:
    sets = salted_join(likes.drop("user_id"), lists, ["likes"], ["request_id"])
    return cands.join(sets, "request_id", "left")


def industry_affinity(cands: DataFrame, buyers: DataFrame) -> DataFrame:
    """Adds ``industry``: cold-start users only, category wanted by the interests."""
    warm = buyers.select("user_id", F.lit(True).alias("warm")).distinct()
    return cands.join(warm, "user_id", "left").withColumn("industry", industry_weight()).drop("warm")


def industry_weight() -> Column:
    return F.when(F.col("warm").isNull() & F.array_contains("wanted", F.col("category")), 0.25)


def mismatch_penalty(cands: DataFrame) -> DataFrame:
    """Adds ``mismatch``: domain-specific category foreign to the interests."""
    return cands.withColumn("mismatch", F.when(F.array_contains("penalised", F.col("category")), 0.65))


# ---- region, session ---------------------------------------------------------------------
def user_region(facts: DataFrame, users: DataFrame) -> DataFrame:
    """Region of most of a user's contracts, from counted (user, item, region) rows."""
    counts = (
        facts.where("customer_region is not null")
        .join(users.select("user_id").distinct(), "user_id", "left_semi")
        .groupBy("user_id", "customer_region")
        .agg(F.sum("times").alias("n"))
    )
    return top_per_group(counts, "user_id", [F.desc("n"), "customer_region"], 1).select("user_id", "customer_region")


def region_affinity(cands: DataFrame, regions: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds ``region``: contracts for the item in the user's region."""
    regional = facts.groupBy("customer_region", "item_id").agg(F.sum("times").alias("regional_cnt"))
    return (
        cands.join(regions, "user_id", "left")
        .join(regional, ["customer_region", "item_id"], "left")
        .withColumn("region", region_weight())
    )


def region_weight() -> Column:
    return F.when(F.col("regional_cnt") > 0, F.round(F.least(0.15 + F.col("regional_cnt") * 0.02, F.lit(0.35)), 6))


POSITIVE_SIGNALS = [("click", 0.2), ("compare", 0.25), ("like", 0.3)]
NEGATIVE_SIGNALS = [("bounce", 0.4), ("hide", 0.8)]


def session_event_boost(cands: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``session_plus`` and ``session_minus``: each signal counts once per item and session."""
    return cands.join(session_signals(events), ["user_id", "session_id", "item_id"], "left")


def session_signals(events: DataFrame) -> DataFrame:
    seen = lambda kinds: sum(
        F.max(F.when(F.col("event_type") == k, w).otherwise(0.0)) for k, w in kinds
    )
    return events.groupBy("user_id", "session_id", "item_id").agg(
        F.round(F.least(seen(POSITIVE_SIGNALS), F.lit(0.5)), 6).alias("p"),
        F.round(F.least(seen(NEGATIVE_SIGNALS), F.lit(0.8)), 6).alias("m"),
    ).select(
        "user_id", "session_id", "item_id", F.when(F.col("p") > 0, F.col("p")).alias("session_plus"),
        F.when(F.col("m") > 0, F.col("m")).alias("session_minus"),
    )


# ---- co-purchase -------------------------------------------------------------------------
def neighbours(items: DataFrame, all_items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` users who most recently bought something the user bought too.

    A neighbour among the first ``k`` overall is among the first ``k + 1`` buyers of the shared
    item that gives its date, so longer buyer lists are never needed: a popular item costs
    ``k + 1`` rows per user instead of all pairs of its buyers.
    """
    recent = all_items.select(
        "item_id", F.col("user_id").alias("neighbour_id"), "last_date"
    )
    heads = top_per_group(recent, "item_id", [F.desc("last_date"), "neighbour_id"], k + 1).drop("rn")
    shared = (
        items.select("user_id", "item_id").join(heads, "item_id").where("user_id <> neighbour_id")
        .groupBy("user_id", "neighbour_id").agg(F.max("last_date").alias("last_date"))
    )
    return top_per_group(shared, "user_id", [F.desc("last_date"), "neighbour_id"], k).select("user_id", "neighbour_id")


def neighbour_counts(near: DataFrame, items: DataFrame, all_items: DataFrame, requests: DataFrame, hits: DataFrame) -> DataFrame:
    """(user_id, item_id, neighbour_count): items of the queries' hits that neighbours bought and the user did not.

    Only purchases of hit items are listed; of neighbours with very many of them, the candidates of their users are looked up.
    """
    wanted = hits.select("item_id").distinct()
    bought = all_items.select(F.col("user_id").alias("neighbour_id"), "item_id").join(wanted, "item_id", "left_semi")
    heavy = bought.groupBy("neighbour_id").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY_BUYER).select("neighbour_id")
    listed = near.join(heavy, "neighbour_id", "left_anti").join(bought, "neighbour_id").groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    watched = near.join(heavy, "neighbour_id", "left_semi")
    asked = requests.select("user_id", "query").join(watched.select("user_id").distinct(), "user_id", "left_semi").distinct()
    pairs = salted_join(asked, hits.select("query", "item_id"), ["query"], ["user_id"]).select("user_id", "item_id").distinct()
    looked_up = pairs.join(watched, "user_id").join(bought, ["neighbour_id", "item_id"], "left_semi").groupBy("user_id", "item_id").agg(
        F.count("*").alias("n"))
    return (
        listed.unionByName(looked_up).join(items.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        .groupBy("user_id", "item_id").agg(F.sum("n").alias("neighbour_count"))
    )


def co_purchase_boost(
    cands: DataFrame, items: DataFrame, all_items: DataFrame, k: int = 50, top: int = 30
) -> DataFrame:
    """(request, item, n, boost): candidates the neighbours bought and the user did not."""
    near = neighbours(items, all_items, k)
    new_pairs = cands.select("user_id", "item_id").distinct().join(
        items.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"
    )
    bought = all_items.select(F.col("user_id").alias("neighbour_id"), "item_id")
    heavy = bought.groupBy("neighbour_id").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY_BUYER).select("neighbour_id")
    # usual neighbours: list their items, at most HEAVY_BUYER per pair, and keep the candidates
    listed = (
        near.join(heavy, "neighbour_id", "left_anti")
        .join(bought, "neighbour_id")
        .groupBy("user_id", "item_id")
        .agg(F.count("*").alias("n"))
        .join(new_pairs, ["user_id", "item_id"], "left_semi")
    )
    # buyers of very many items: look up the candidates instead
    looked_up = (
        new_pairs.join(near.join(heavy, "neighbour_id", "left_semi"), "user_id")
        .join(bought, ["neighbour_id", "item_id"], "left_semi")
        .groupBy("user_id", "item_id")
        .agg(F.count("*").alias("n"))
    )
    counts = listed.unionByName(looked_up).groupBy("user_id", "item_id").agg(F.sum("n").alias("neighbour_count"))
    rows = cands.select("request_id", "user_id", "item_id").join(counts, ["user_id", "item_id"])
    best = top_per_group(rows, "request_id", [F.desc("neighbour_count"), "item_id"], top)
    peak = F.max("neighbour_count").over(W.partitionBy("request_id"))  # at most ``top`` rows
    return best.select(
        "request_id", "item_id", "neighbour_count",
        F.round(F.lit(0.4) * F.col("neighbour_count") / peak, 3).alias("co_purchase"),
    )


# ---- sum of factors ----------------------------------------------------------------------
def explanations(multiplier: Column | float = 1.0) -> Column:
    """Non-null factor columns as (factor, weight) structs."""
    part = lambda name, w: F.when(w.isNotNull(), F.struct(F.lit(name).alias("factor"), w.cast("double").alias("weight")))
    scale = lambda c: F.col(c) * multiplier
    return F.array_compact(F.array(
        part("history", scale("history")), part("category", scale("affinity")), part("category", scale("industry")),
        part("profile_mismatch", -F.col("mismatch")), part("region", F.col("region")),
        part("session", F.col("session_plus")), part("negative", -F.col("session_minus")),
        part("collaborative", F.col("co_purchase")),
    ))


def net_score(cands: DataFrame) -> DataFrame:
    """Adds boost, penalty, net_score and explanations from the factor columns."""
    total = lambda cols: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return (
        cands.withColumn("boost", F.round(total(["history", "affinity", "industry", "region", "session_plus", "co_purchase"]), 6))
        .withColumn("penalty", F.round(total(["mismatch", "session_minus"]), 6))
        .withColumn("net_score", F.round(F.col("boost") - F.col("penalty"), 6))
        .withColumn("explanations", explanations())
    )


# ---- decay -------------------------------------------------------------------------------
def last_seen_category(events: DataFrame) -> DataFrame:
    return events.where("category is not null").groupBy("user_id", "category").agg(F.max("ts").alias("last_at"))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400e6)


def decay_weights(weights: DataFrame, last_seen: DataFrame, now: Column) -> DataFrame:
    """Halve a category weight every 14 days since it was last seen; unknown stays."""
    days = days_between(now, F.col("last_at"))
    return weights.join(last_seen, ["user_id", "category"], "left").select(
        "user_id", "category",
        F.round(
            F.coalesce(F.col("weight") * F.pow(F.lit(0.5), days / HALF_LIFE_DAYS), F.col("weight")), 6
        ).alias("weight"),
    )


# ---- profiles ----------------------------------------------------------------------------
def category_weights(categories: DataFrame) -> DataFrame:
    """Share of each category in a user's contracts."""
    total = F.sum("cnt").over(W.partitionBy("user_id"))  # a user has at most one row per category
    return categories.select("user_id", "category", (F.col("cnt") / total).alias("weight"))


def profile_vectors(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Unit mean vector of a user's purchases, repeated purchases counted.

    Whole vectors go to their user's task; their components, a row each, are summed there and not shuffled.
    """
    sums = (
        items.select("user_id", "item_id", "times").join(vectors, "item_id").repartition("user_id")
        .select("user_id", "times", F.posexplode("vector").alias("pos", "x"))
        .groupBy("user_id", "pos")
        .agg((F.sum(F.col("x") * F.col("times")) / F.sum("times")).alias("m"))
    )
    packed = sums.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms"))
    size = norm(F.col("ms.m"))
    return packed.select("user_id", F.transform("ms.m", lambda x: x / (size + 1e-9)).alias("vector"))


def profile_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("user_id").agg(F.sum("times").alias("interaction_count"), F.count("*").alias("positive_items"))


def suffix_sums(df: DataFrame, key: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over a row and all later rows of its key, in two levels.

    Rows are summed inside a bucket (say a day) and the few bucket totals over the key, so a key
    with very many rows is spread over its buckets.
    """
    inner = W.partitionBy(key, bucket).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    totals = df.groupBy(key, bucket).agg(F.sum(value).alias("_t"))
    later = W.partitionBy(key).orderBy(F.desc(bucket)).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(key, bucket, F.coalesce(F.sum("_t").over(later), F.lit(0.0)).alias("_later"))
    return df.join(offsets, [key, bucket]).withColumn(out, F.sum(value).over(inner) + F.col("_later")).drop("_later")


def profile_update_weights(
    initial: DataFrame, events: DataFrame, actions: DataFrame, rate: float = 0.1, bucket: str = "day"
) -> DataFrame:
    """Category weights after folding a user's events in time order.

    Each event adds ``d`` to its category and divides all weights by ``1 + d``. Unrolled, event t
    contributes ``d / (product of (1 + d) from t on)`` and an initial weight is divided by the
    product over all events. Without initial weights the first event sets its category to one.
    """
    steps = (
        events.where("category is not null")
        .join(actions.withColumnRenamed("action", "event_type"), "event_type")
        .where("weight > 0")
        .select("user_id", "category", "ts", "event_id", (F.col("weight") * rate).alias("d"))
    )
    has_start = initial.select("user_id", F.lit(True).alias("known")).distinct()
    firsts = steps.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    marks = firsts.join(has_start, "user_id", "left").select(
        "user_id", F.when(F.col("known").isNull(), F.col("f.event_id")).alias("first_id")
    )
    marked = salted_join(steps, marks, ["user_id"], ["event_id"]).withColumn(
        "starts", F.coalesce(F.col("event_id") == F.col("first_id"), F.lit(False))
    )
    logs = marked.withColumn("g", F.when(F.col("starts"), 0.0).otherwise(F.log1p("d"))).withColumn(
        "bucket", F.date_trunc(bucket, "ts")
    )
    summed = suffix_sums(logs, "user_id", "bucket", ["ts", "event_id"], "g", "tail")
    gains = summed.select(
        "user_id", "category", (F.when(F.col("starts"), 1.0).otherwise(F.col("d")) * F.exp(-F.col("tail"))).alias("w")
    )
    shrink = logs.groupBy("user_id").agg(F.sum("g").alias("total"))
    kept = initial.join(shrink, "user_id", "left").select(
        "user_id", "category", (F.col("weight") * F.exp(-F.coalesce("total", F.lit(0.0)))).alias("w")
    )
    return kept.unionByName(gains).groupBy("user_id", "category").agg(F.round(F.sum("w"), 6).alias("weight"))


def profile_update_embedding(initial: DataFrame, events: DataFrame, vectors: DataFrame, actions: DataFrame) -> DataFrame:
    """Profile vector after the renormalised moving average over a user's events.

    The fold is order-dependent; users are hashed to tasks and each task streams its rows in time
    order, holding one vector only.
    """
    steps = (
        events.join(actions.withColumnRenamed("action", "event_type"), "event_type")
        .where("weight > 0")
        .join(vectors, "item_id")
        .select("user_id", F.lit(1).alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "vector")
    )
    start = initial.select(
        "user_id", F.lit(0).alias("kind"), F.lit(None).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_id"), "vector"
    )
    ordered = start.unionByName(steps).repartition("user_id").sortWithinPartitions("user_id", "kind", "ts", "event_id")

    def fold(batches):
        import numpy as np

        user, state = None, None
        for pdf in batches:
            done = []
            for uid, kind, vec in zip(pdf["user_id"], pdf["kind"], pdf["vector"]):
                vec = np.asarray(vec)
                if uid != user:
                    if user is not None:
                        done.append((user, state))
                    user, state = uid, vec
                else:
                    mixed = 0.9 * state + 0.1 * vec
                    state = mixed / (np.linalg.norm(mixed) + 1e-9)
            if done:
                yield pd.DataFrame(done, columns=["user_id", "vector"])
        if user is not None:
            yield pd.DataFrame([(user, state)], columns=["user_id", "vector"])

    return ordered.mapInPandas(fold, "user_id long, vector array<double>")


POSITIVE_ACTIONS = ("click", "compare", "add_to_compare", "purchase")


def profile_update_sets(events: DataFrame) -> DataFrame:
    """Per (user, item): ever positive, last signal negative, clicks since the last bounce."""
    signals = events.where(F.col("event_type").isin("bounce", *POSITIVE_ACTIONS)).select(
        "user_id", "item_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "bounce").alias("bad")
    )
    bounced = signals.where("bad").groupBy("user_id", "item_id").agg(F.max("at").alias("last_bounce"))
    joined = salted_join(signals, bounced, ["user_id", "item_id"], ["at"], how="left")
    since = ~F.col("bad") & (F.col("last_bounce").isNull() | (F.col("at") > F.col("last_bounce")))
    return joined.groupBy("user_id", "item_id").agg(
        F.max(~F.col("bad")).alias("is_positive"),
        F.max_by("bad", "at").alias("is_negative"),
        F.count_if(since).alias("session_clicks"),
    )


def profile_rerank(
    cands: DataFrame, weights: DataFrame, vectors: DataFrame, item_vectors: DataFrame, marks: DataFrame
) -> DataFrame:
    """Base score plus category weight, profile similarity, purchases and negative signals.

    ``marks(user_id, item_id, is_positive, is_negative)``; users without a profile keep the base.
    """
    j = (
        cands.join(weights.select("user_id", "category", "weight"), ["user_id", "category"], "left")
        .join(vectors.withColumnRenamed("vector", "pv"), "user_id", "left")
        .join(item_vectors.withColumnRenamed("vector", "iv"), "item_id", "left")
        .join(marks.select("user_id", "item_id", "is_positive", "is_negative"), ["user_id", "item_id"], "left")
    )
    return reranked(j)


def reranked(j: DataFrame) -> DataFrame:
    """``profile_rerank`` of candidates that carry weight, pv, iv and marks."""
    sim = dot(F.col("pv"), F.col("iv"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    p = (
        zero(F.col("weight") * BOOST) + zero(sim * (BOOST * 0.5))
        + F.when(flag("is_positive"), BOOST * 0.3).otherwise(0.0)
        - F.when(flag("is_negative"), BOOST * NEGATIVE).otherwise(0.0)
    )
    pct = F.floor(F.col("weight") * 100 + 1e-9).cast("int")
    # fixed values: texts of the reasons
    reasons = F.array_compact(F.array(
        F.when(
            F.col("weight").isNotNull(),
            F.format_string("Matches your frequent category '%s' (%d%% of purchases)", F.col("category"), pct),
        ),
        F.when(sim > 0.5, "Similar to your purchase history profile"),
        F.when(flag("is_positive"), "Previously purchased item"),
        F.when(flag("is_negative"), "Ranked lower: you quickly returned from this item"),
    ))
    return (
        j.withColumn("personal_score", F.round(p, 8))
        .withColumn("final_score", F.round(F.col("base_score") + F.col("personal_score"), 8))
        .withColumn("reasons", reasons)
        .drop("pv", "iv")
    )


def profile_summary(users: DataFrame, weights: DataFrame, counts: DataFrame, sets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Five strongest categories and the counters of each user's profile."""
    rounded = weights.withColumn("w", F.round("weight", 3))
    top = top_per_group(rounded, "user_id", [F.desc("w"), "category"], 5).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "category", "w"))).alias("tops")
    )
    total = weights.groupBy("user_id").agg(F.count("*").alias("total_categories"))
    marks = sets.groupBy("user_id").agg(
        F.count_if("is_negative").alias("negative_signals"), F.sum("session_clicks").alias("session_clicks")
    )
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        users.select("user_id").distinct().join(top, "user_id", "left").join(total, "user_id", "left")
        .join(counts, "user_id", "left").join(marks, "user_id", "left")
        .join(vectors.select("user_id", F.lit(True).alias("hv")), "user_id", "left")
        .select(
            "user_id",
            F.when(F.coalesce(F.col("total_categories"), F.col("interaction_count"), F.col("negative_signals")).isNull(), "no_profile")
            .otherwise("active").alias("status"),
            F.coalesce(F.transform("tops", lambda s: F.concat_ws("=", s["category"], s["w"].cast("decimal(5,3)"))), F.array().cast("array<string>")).alias("top_categories"),
            n("total_categories"), n("interaction_count"), n("positive_items"), n("negative_signals"), n("session_clicks"),
            F.coalesce("hv", F.lit(False)).alias("has_embedding"),
        )
    )


def interest_summary(categories: DataFrame, weights: DataFrame, last_seen: DataFrame, now: Column) -> DataFrame:
    """Weight and trend of the eight strongest categories; marks active (3) and fading (2)."""
    contracts = top_per_group(categories, "user_id", [F.desc("cnt"), "category"], 10).select("user_id", "category", "cnt")
    j = (
        contracts.join(weights.select("user_id", "category", F.col("weight").alias("sw")), ["user_id", "category"], "full")
        .join(last_seen, ["user_id", "category"], "left")
        .withColumn("cnt", F.coalesce("cnt", F.lit(0)))
        .withColumn("sw", F.coalesce("sw", F.lit(0.0)))
        .withColumn("days", F.coalesce(F.floor(days_between(now, F.col("last_at"))), F.lit(999)))
    )
    base = F.least(F.col("cnt") / 50.0, F.lit(1.0))
    fade = F.greatest(F.lit(0.0), 1 - F.col("days") / 30.0)
    weight = F.least(F.lit(1.0), base * 0.6 + F.col("sw") * 0.4) * (0.3 + 0.7 * fade)
    trend = (
        F.when((F.col("sw") > 0.3) & (F.col("days") < 1), "rising").when(F.col("days") > 14, "fading").otherwise("stable")
    )
    rows = j.select(
        "user_id", "category", F.col("cnt").alias("contract_count"), F.round(weight, 3).alias("weight"), trend.alias("trend"),
        F.when(F.col("days") < 999, F.col("days")).otherwise(-1).alias("last_interaction_days"),
    )
    order = [F.desc("weight"), "category"]
    ranked = top_per_group(rows, "user_id", order, 8)
    fading = top_per_group(rows.where("trend = 'fading'"), "user_id", order, 2).select("user_id", "category", F.lit(True).alias("is_fading"))
    return ranked.join(fading, ["user_id", "category"], "left").select(
        "user_id", "category", "contract_count", "weight", "trend", "last_interaction_days", F.col("rn").alias("position"),
        ((F.col("weight") > 0.3) & (F.col("rn") <= 3)).alias("is_active"),
        F.coalesce("is_fading", F.lit(False)).alias("is_fading"),
    )


def merge_session_interest(summary: DataFrame, clicks: DataFrame) -> DataFrame:
    """Overlay live clicks: clicked categories rise, unseen ones enter with min(0.1 n, 0.3)."""
    live = clicks.groupBy("user_id", "category").agg(F.count("*").alias("n"))
    j = summary.join(live, ["user_id", "category"], "full")
    return j.select(
        "user_id", "category", F.coalesce("n", F.lit(0)).alias("click_count"),
        F.coalesce("contract_count", F.lit(0)).alias("contract_count"),
        F.coalesce("weight", F.round(F.least(F.col("n") * 0.1, F.lit(0.3)), 6)).alias("weight"),
        F.when(F.col("n") > 0, "rising").otherwise(F.col("trend")).alias("trend"),
        F.when(F.col("weight").isNull(), 0).otherwise(F.col("last_interaction_days")).alias("last_interaction_days"),
    )


def user_stats(categories: DataFrame, items: DataFrame) -> DataFrame:
    """Number of contracts and the six most purchased categories."""
    total = items.groupBy("user_id").agg(F.sum("times").alias("total_contracts"))
    top = top_per_group(categories, "user_id", [F.desc("cnt"), "category"], 6).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "category"))).alias("t")
    )
    return total.join(top, "user_id", "left").select("user_id", "total_contracts", F.col("t.category").alias("top_categories"))


def allowed_categories(profiles: DataFrame, categories: DataFrame, industry_categories: DataFrame) -> DataFrame:
    """Industry list and own contract categories per user."""
    by_industry = salted_join(
        profiles.where("industry is not null").select("user_id", "industry"), industry_categories, ["industry"], ["user_id"]
    ).select("user_id", "category")
    return by_industry.unionByName(categories.select("user_id", "category")).distinct()


def user_category_facets(allowed: DataFrame, counts: DataFrame) -> DataFrame:
    """Real categories for a user's allowed names: in name order each takes the largest free match.

    Names match if equal or contained either way; they meet on three letters of the shorter name.
    """
    names = allowed.select(F.col("category").alias("name")).distinct()
    head = lambda c: F.substring(F.lower(c), 1, 3)
    inside = lambda a, b: F.contains(F.lower(b), F.lower(a))
    n_in_r = names.select("name", head("name").alias("k")).join(
        counts.select("category", "cnt", F.explode(short_substrings(F.lower("category"))).alias("k")), "k"
    ).where(inside("name", "category"))
    r_in_n = counts.select("category", "cnt", head("category").alias("k")).join(
        names.select("name", F.explode(short_substrings(F.lower("name"))).alias("k")), "k"
    ).where(inside("category", "name"))
    pairs = n_in_r.select("name", "category", "cnt").unionByName(r_in_n.select("name", "category", "cnt")).distinct()
    options = pairs.groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), F.col("category").alias("real")))).alias("options")
    )
    per_user = (
        salted_join(allowed.withColumnRenamed("category", "name"), options, ["name"], ["user_id"])
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("name", "options"))).alias("lists"))  # at most one per category name
    )
    empty = F.array().cast("array<struct<neg:bigint,real:string>>")

    def take(used, entry):
        free = F.filter(entry["options"], lambda o: ~F.exists(used, lambda u: u["real"] == o["real"]))
        return F.when(F.size(free) > 0, F.concat(used, F.slice(free, 1, 1))).otherwise(used)

    return per_user.select("user_id", F.explode(F.aggregate("lists", empty, take)).alias("m")).select(
        "user_id", F.col("m.real").alias("category"), (-F.col("m.neg")).alias("cnt")
    )
