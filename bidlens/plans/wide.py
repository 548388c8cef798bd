"""Candidates that carry their signals: joined per request, user and hit, so that no row per candidate is shuffled.

A part names what its columns are made of. ``carried`` joins all parts' tables below the fan-out and applies their formulas above it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.operators import analytics as A
from bidlens.operators import notes as N
from bidlens.operators import personal as P
from bidlens.operators import ranking as K
from bidlens.operators import retrieval as R
from bidlens.operators import sessions as S
from bidlens.plans import q_personal as QP
from bidlens.plans import q_sessions as QS


def same(df: DataFrame, *_) -> DataFrame:
    return df


@dataclass
class Part:
    name: str
    signals: Callable | None = None  # tables (user_id, item_id, values), see notes
    met: Callable = same  # on the signals that met candidates
    users: Callable = lambda t: []  # tables with one row per user
    requests: Callable = lambda t, requests: requests
    hits: Callable = lambda t, hits: hits
    columns: Callable = same  # on candidates that carry all of these


def carried(t, hits: DataFrame, *parts: Part) -> DataFrame:
    hits = t.stage("hits", lambda: hits)
    met = [t.stage(f"met-{p.name}", lambda p=p: p.met(N.met_signals(p.signals(t, hits), t.requests, hits))) for p in parts if p.signals]
    notes = t.stage("notes", lambda: N.noted(met)) if met else None
    requests = t.requests
    for p in parts:
        requests, hits = p.requests(t, requests), p.hits(t, hits)
    requests = t.stage("asked", lambda: requests)  # short plans keep the driver small
    people = [u for p in parts for u in p.users(t)]
    if people:
        each = QP.users(t)
        for u in people:
            each = each.join(u, "user_id", "left")
        requests = requests.join(t.stage("people", lambda: each), "user_id", "left")
    out = t.fan_out(t.stage("full-hits", lambda: hits), requests, notes)
    if notes is not None:
        out = N.read_notes(out, [c for df in met for c in df.columns if c not in ("request_id", "item_id")])
    for p in parts:
        out = p.columns(out)
    return out


# ---- personal factors ----------------------------------------------------------------------
def factor_signals(t, hits):
    seen = P.session_signals(t.user_events).where("session_plus is not null or session_minus is not null")
    return [QP.items(t).select("user_id", "item_id", "times"), seen, QP.neighbour_counts(t, hits)]


def factor_users(t):
    top = P.top_categories(QP.categories(t)).groupBy("user_id").agg(F.collect_list("category").alias("top_categories"))
    regions = P.user_region(t.regional_facts, QP.users(t))
    return [top, regions, QP.items(t).select("user_id", F.lit(True).alias("warm")).distinct()]


def with_regions(t, hits):
    bought = t.regional_facts.where("customer_region is not null").join(hits.select("item_id").distinct(), "item_id", "left_semi")
    regional = bought.groupBy("item_id", "customer_region").agg(F.sum("times").alias("regional_cnt"))
    return hits.join(N.packed(regional, ["item_id"], "customer_region", "regional_cnt", "regions"), "item_id", "left")


def factor_columns(cands):
    return P.net_score(P.mismatch_penalty(
        cands.withColumn("history", P.history_weight())
        .withColumn("affinity", F.when(F.array_contains("top_categories", F.col("category")), P.AFFINITY))
        .withColumn("industry", P.industry_weight())
        .withColumn("regional_cnt", F.element_at("regions", F.col("customer_region")))
        .withColumn("region", P.region_weight())
    )).drop("top_categories", "warm", "regions", "wanted", "penalised")


FACTORS = Part(
    "factors", factor_signals, lambda met: N.best_of_request(met, "neighbour_count", QP.CO_PURCHASED).drop("neighbour_count"),
    factor_users, lambda t, requests: QP.interested(t, requests), with_regions, factor_columns,
)


# ---- features ------------------------------------------------------------------------------
def mark_signals(t, hits):
    return [QP.marks(t, QP.items(t))]


def profile_users(t):
    return [N.packed(QP.folded(t), ["user_id"], "category", "weight", "weights"), QP.vectors(t).withColumnRenamed("vector", "pv")]


def feature_users(t):
    clicks = QP.item_sets(t).groupBy("user_id").agg(F.sum("session_clicks").alias("session_clicks"))
    counts = P.profile_counts(QP.items(t)).select("user_id", "interaction_count")
    return [*profile_users(t), counts, clicks]


def with_vectors(t, hits):
    return hits.join(t.item_vectors.withColumnRenamed("vector", "iv"), "item_id", "left")


def with_popularity(t, hits):
    popularity = A.popularity_of(t.item_totals).select("item_id", "popularity_score")
    return with_vectors(t, hits).join(popularity, "item_id", "left")


def with_weight(cands):
    return cands.withColumn("weight", F.element_at("weights", F.col("category"))).drop("weights")


FEATURES = Part("features", mark_signals, users=feature_users, hits=with_popularity, columns=lambda c: K.with_features(with_weight(c)))
PROFILE = Part("profile", mark_signals, users=profile_users, hits=with_vectors, columns=lambda c: P.reranked(with_weight(c)))


# ---- session -------------------------------------------------------------------------------
def session_signals(t, hits):
    return [S.session_adjustments(QS.live(t)), S.cross_deltas(QS.remembered(t)), S.like_dislike_boost(QS.likes(t))]


def with_momentum(t, requests):
    strength = S.category_strength(t.stage("momentum", lambda: S.category_momentum(t.user_events)))
    return requests.join(N.packed(strength, ["user_id", "session_id"], "category", "momentum", "strengths"), ["user_id", "session_id"], "left")


def with_collective(t, hits):
    return S.collective_boost(hits, t.stage("patterns", lambda: S.collective_patterns(t.user_events)))


def session_columns(cands):
    return K.session_delta(cands.withColumn("momentum", F.element_at("strengths", F.col("category"))).drop("strengths"))


SESSION = Part("session", session_signals, requests=with_momentum, hits=with_collective, columns=session_columns)


# ---- exact names ---------------------------------------------------------------------------
PIN = Part(
    "pin",
    requests=lambda t, requests: requests.join(R.safe_sets(t.requests, t.industry_categories), "request_id", "left"),
    hits=lambda t, hits: hits.join(R.domain_marks(t.domain_categories), "category", "left"),
    columns=R.pinned,
)
