"""Registered queries: the event stream and its stateful twins, run over the whole event table."""

from pyspark.sql import functions as F

from bidlens.operators import sessions as S
from bidlens.plans.q_sessions import now, stamp
from bidlens.plans.registry import query
from bidlens.sources.adapters import shape_events
from bidlens.sources.cleaning import validated_events
from bidlens.sources.files import event_source
from bidlens.streaming import events as E


def arriving(t):
    raw = event_source(t.spark, t.folder, t.raw("events").schema, "events.parquet")
    return shape_events(raw, t.catalog_base)


def stream(t):
    return validated_events(arriving(t))[0]


CLOSED = "ended_at + INTERVAL 1 HOUR <= (SELECT now_ts FROM t_event_now) - INTERVAL 1 HOUR"


@query("event_source", "SELECT event_id, user_id, item_id, event_type, session_id, category FROM t_events")
def read_events(t):
    path, _ = E.run_validated(arriving(t), "events")
    return E.read_slices(t.spark, path).select("event_id", "user_id", "item_id", "event_type", "session_id", "category")


@query("session_counters_stream", f"""
SELECT user_id, session_id, item_id, sign, least(n, 3) AS cnt, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM t_counters WHERE {CLOSED}
""")
def session_counters_stream(t):
    out = E.read_slices(t.spark, E.run_available(E.session_counters(stream(t)), "append", "counters"))
    return out.select("user_id", "session_id", "item_id", "sign", "cnt", stamp("last_at").alias("last_at"))


@query("category_momentum_stream", f"""
SELECT user_id, session_id, category, n, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM t_momentum WHERE {CLOSED}
""")
def category_momentum_stream(t):
    out = E.read_slices(t.spark, E.run_available(E.category_momentum(stream(t)), "append", "momentum"))
    return out.select("user_id", "session_id", "category", "n", stamp("last_at").alias("last_at"))


@query("flush_strong_signals_stream", f"""
SELECT user_id, item_id, sign, strftime(max(last_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM t_counters WHERE least(n, 3) >= 2 AND {CLOSED} GROUP BY 1, 2, 3
""")
def flush_strong_signals_stream(t):
    path = E.run_available(E.session_counters(stream(t)), "append", "memory", shape=S.strong_signals)
    return E.read_slices(t.spark, path).groupBy("user_id", "item_id", "sign").agg(stamp(F.max("last_at")).alias("last_at"))


@query("like_dislike_state_stream", "SELECT user_id, item_id, state FROM t_likes_state")
def like_dislike_state_stream(t):
    path = E.run_available(E.like_dislike_state(stream(t)), "update", "votes")
    return E.live_votes(t.spark, path, now(t)).select("user_id", "item_id", "state")


@query("last_category_touch_stream", """
SELECT user_id, category, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM t_events, t_event_now
WHERE event_type IN ('click', 'view', 'like', 'compare') GROUP BY 1, 2, now_ts HAVING max(ts) >= now_ts - INTERVAL 10 DAY
""")
def last_category_touch_stream(t):
    """The log spans 30 days; ten instead of 60 let touches expire."""
    path = E.run_available(E.last_category_touch(stream(t), ttl_days=10), "update", "touch")
    rows = E.read_latest(t.spark, path, ["user_id", "category"]).where(F.col("last_at") >= now(t) - F.expr("interval 10 days"))
    return rows.withColumn("last_at", stamp("last_at"))


@query("popular_queries_stream", "SELECT q AS query, count(*) AS cnt FROM t_asked GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def popular_queries_stream(t):
    counts = E.read_latest(t.spark, E.run_available(E.query_counts(stream(t)), "update", "queries"), ["query"])
    return counts.orderBy(F.desc("cnt"), "query").limit(10)


@query("collective_patterns_stream", "SELECT * FROM t_patterns")
def collective_patterns_stream(t):
    path = E.run_available(E.pattern_users(stream(t)), "update", "patterns")
    return E.collective_patterns(E.read_latest(t.spark, path, ["query", "product_name", "range"]))


@query("first_click_dedup_stream", "SELECT DISTINCT user_id, session_id, item_id FROM t_events WHERE event_type = 'click'")
def first_click_dedup_stream(t):
    out = E.read_slices(t.spark, E.run_available(E.first_click_dedup(stream(t)), "append", "clicks"))
    return out.select("user_id", "session_id", "item_id")


@query("bounce_detection_stream", """
SELECT user_id, session_id, item_id, event_id, round(gap, 6) AS open_seconds FROM (
  SELECT *, (epoch_us(next) - epoch_us(ts)) / 1e6 AS gap FROM (
    SELECT *, lead(ts) OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) AS next FROM t_events)), t_event_now
WHERE event_type = 'click' AND gap < 600 AND epoch_ms(next) < epoch_ms(now_ts) - 3600000
""")
def bounce_detection_stream(t):
    """Bounces whose next event the watermark has passed; the hour before the newest event is still open."""
    out = E.read_slices(t.spark, E.run_available(E.bounce_detection(stream(t), 600.0), "append", "bounces"))
    return out.select("user_id", "session_id", "item_id", "event_id", F.round("open_seconds", 6).alias("open_seconds"))
