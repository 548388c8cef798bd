"""The whole search for a table of requests, as one Spark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import text as X
from bidlens.operators import analytics as A
from bidlens.operators import ranking as K
from bidlens.plans import wide
from bidlens.plans.q_analytics import as_of
from bidlens.plans.q_retrieval import hybrid_hits, lexical_hits
from bidlens.plans.q_text import strategy_dim


def features(t) -> DataFrame:
    """Lexical candidates with the features of the rankers."""
    return wide.carried(t.staged(), lexical_hits(t), wide.FEATURES)


def intent_text(df: DataFrame) -> DataFrame:
    """Builders repeat their last purchase, so their requests read as reorders."""
    text = F.when(F.col("interests")[0] == "BUILDING", F.concat(F.lit("снова "), "query")).otherwise(F.col("query"))
    return df.withColumn("intent", X.detect_intent(text))


def with_intent(t, requests: DataFrame) -> DataFrame:
    """Requests with their intent and its multipliers."""
    return K.with_strategy(intent_text(requests), strategy_dim(t))


INTENT = wide.Part("intent", requests=with_intent, columns=K.multiplied)  # after the factors


def with_session(t) -> DataFrame:
    """Lexical candidates with all session and memory signals."""
    return wide.carried(t.staged(), lexical_hits(t), wide.SESSION)


def with_popularity(hits: DataFrame) -> DataFrame:
    """Orders of a hit as a share of the most ordered one of its query."""
    peak = F.max("order_count").over(W.partitionBy("query"))  # bounded by the page pool
    return hits.withColumn("popularity_norm", F.round(F.col("order_count") / F.greatest(peak, F.lit(1)), 6))


def scored(t, find=lexical_hits) -> DataFrame:
    """Candidates with factors, features, session signals and the blended score.

    Signal tables (counted purchases, profiles, session state, popularity) and what of them meets a candidate are written
    to the shared folder once; scoring is then one pass over the requests, whose candidates never travel. What hangs on the
    query and item or on the request alone (name bonus, intent) is worked out for hits and requests, not for candidates.
    """
    t.staged()
    hits = K.with_name_bonus(with_popularity(find(t)))
    out = wide.carried(t, hits, wide.PIN, wide.FACTORS, wide.SESSION, wide.FEATURES, INTENT).withColumn("model_score", K.linear_score())
    out = K.minmax_norm(out, "model_score", "model_norm")
    return out.withColumn("score", K.blend_model()).withColumn("score_fallback", K.blend_fallback())


def batch_search(t) -> DataFrame:
    """One page of results per request, with price and explanations.

    Candidates are found once per distinct query, not per request.
    """
    page = K.paginate(K.final_order(scored(t, hybrid_hits)))
    prices = A.price_info(t.purchases, as_of(t))
    return page.join(prices, "item_id", "left").select(
        "request_id", "position", "item_id", "name", "category", K.shown("score"), "intent",
        F.array_join(F.transform("explanations", lambda e: e["factor"]), "|").alias("factors"), "avg_price", "price_trend",
    )
