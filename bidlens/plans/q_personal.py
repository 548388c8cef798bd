"""Registered queries: personalisation of the request log's candidates."""

from pyspark.sql import functions as F

from bidlens.functions import dicts
from bidlens.operators import analytics as A
from bidlens.operators import notes as N
from bidlens.operators import personal as P
from bidlens.plans.q_analytics import as_of
from bidlens.plans.q_retrieval import candidates, lexical_hits
from bidlens.plans.registry import query, shared
from bidlens.session import cut_lineage


CO_PURCHASED = 30  # fixed value: items of a request that neighbours add


def users(t):
    return t.requests.select("user_id").distinct()


def items(t):
    return t.stage("items", lambda: P.items_of(t.facts, users(t)))


def all_items(t):
    return t.facts


def categories(t):
    return t.stage("categories", lambda: P.user_categories(items(t), t.catalog_base))


def vectors(t):
    return t.stage("profile-vectors", lambda: P.profile_vectors(items(t), t.item_vectors))


def actions(t):
    return t.dim(dicts.ACTION_WEIGHTS, "action string, weight double")


def event_now(t):
    return A.latest(t.raw("events"), "ts")


def interested(t, base=None):
    likes = P.effective_interests(t.requests, t.profiles)
    lists = t.stage(
        "interest-lists",
        lambda: P.interest_categories(likes, t.industry_categories, t.universal_categories, t.domain_categories),
    )
    return P.with_interests(candidates(t) if base is None else base, likes, lists)


shared("t_user_items", "SELECT customer_id AS user_id, item_id, count(*) AS times, max(contract_date) AS last_date FROM t_purchases GROUP BY 1, 2")
shared("t_user_cats", """
SELECT user_id, category, CAST(sum(times) AS BIGINT) AS cnt FROM t_user_items JOIN t_items USING (item_id) GROUP BY 1, 2
""")
shared("t_history", """
SELECT request_id, item_id, times, round(least(0.5 + times * 0.1, 1), 6) AS history FROM t_cands JOIN t_user_items USING (user_id, item_id)
""")
shared("t_affinity", """
SELECT request_id, item_id, 0.3::DOUBLE AS affinity FROM t_cands JOIN (
  SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, category) AS rn FROM t_user_cats)
  USING (user_id, category) WHERE rn <= 5
""")
shared("t_likes", """
SELECT request_id, r.user_id, coalesce(p.interests, CASE WHEN p.industry IS NOT NULL THEN [p.industry] END, [r.segment]) AS likes
FROM t_requests r LEFT JOIN t_profiles p USING (user_id)
""")
shared("t_likes_each", "SELECT request_id, user_id, unnest(likes) AS industry FROM t_likes")
shared("t_industry_aff", """
SELECT DISTINCT c.request_id, c.item_id, 0.25::DOUBLE AS industry FROM t_cands c JOIN t_likes_each l USING (request_id)
JOIN t_industry_categories i ON i.industry = l.industry AND i.category = c.category
WHERE c.user_id NOT IN (SELECT user_id FROM t_user_items)
""")
shared("t_mismatch", """
SELECT request_id, item_id, 0.65::DOUBLE AS mismatch FROM t_cands c WHERE category IN (SELECT category FROM t_domain)
 AND category NOT IN (SELECT category FROM t_universal)
 AND NOT EXISTS (SELECT 1 FROM t_likes_each l JOIN t_industry_categories i USING (industry) WHERE l.request_id = c.request_id AND i.category = c.category)
 AND NOT EXISTS (SELECT 1 FROM t_likes_each l JOIN t_domain d USING (industry) WHERE l.request_id = c.request_id AND d.category = c.category)
""")
shared("t_user_region", """
SELECT user_id, customer_region FROM (SELECT customer_id AS user_id, customer_region,
  row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, customer_region) AS rn FROM t_contracts GROUP BY 1, 2) WHERE rn = 1
""")
shared("t_region_aff", """
SELECT request_id, c.item_id, regional_cnt, round(least(0.15 + regional_cnt * 0.02, 0.35), 6) AS region
FROM t_cands c JOIN t_user_region u USING (user_id) JOIN (
  SELECT customer_region, item_id, count(*) AS regional_cnt FROM t_contracts GROUP BY 1, 2) r
  ON r.customer_region = u.customer_region AND r.item_id = c.item_id
""")
shared("t_session_sig", """
SELECT request_id, item_id, nullif(round(least(p, 0.5), 6), 0) AS session_plus, nullif(round(least(m, 0.8), 6), 0) AS session_minus
FROM t_cands JOIN (SELECT user_id, session_id, item_id,
   sum(DISTINCT CASE event_type WHEN 'click' THEN 0.2 WHEN 'compare' THEN 0.25 WHEN 'like' THEN 0.3 ELSE 0 END) AS p,
   sum(DISTINCT CASE event_type WHEN 'bounce' THEN 0.4 WHEN 'hide' THEN 0.8 ELSE 0 END) AS m
  FROM t_events GROUP BY 1, 2, 3) USING (user_id, session_id, item_id)
""")
shared("t_copurchase", """
WITH n AS (SELECT user_id, nb FROM (SELECT a.user_id, b.user_id AS nb,
     row_number() OVER (PARTITION BY a.user_id ORDER BY max(b.last_date) DESC, b.user_id) AS rn
   FROM t_user_items a JOIN t_user_items b ON a.item_id = b.item_id AND a.user_id <> b.user_id
   WHERE a.user_id IN (SELECT user_id FROM t_requests) GROUP BY 1, 2) WHERE rn <= 50),
  c AS (SELECT n.user_id, p.item_id, count(*) AS neighbour_count FROM n JOIN t_user_items p ON p.user_id = n.nb
        WHERE NOT EXISTS (SELECT 1 FROM t_user_items o WHERE o.user_id = n.user_id AND o.item_id = p.item_id) GROUP BY 1, 2),
  r AS (SELECT request_id, item_id, neighbour_count, row_number() OVER (PARTITION BY request_id ORDER BY neighbour_count DESC, item_id) AS rn
        FROM t_cands JOIN c USING (user_id, item_id))
SELECT request_id, item_id, neighbour_count, round(CAST(0.4 AS DOUBLE) * neighbour_count / max(neighbour_count) OVER (PARTITION BY request_id), 3) AS co_purchase
FROM r WHERE rn <= 30
""")
shared("t_factors", """
SELECT c.*, times, history, affinity, industry, mismatch, region, session_plus, session_minus, co_purchase
FROM t_cands c LEFT JOIN t_history USING (request_id, item_id) LEFT JOIN t_affinity USING (request_id, item_id)
LEFT JOIN t_industry_aff USING (request_id, item_id) LEFT JOIN t_mismatch USING (request_id, item_id)
LEFT JOIN t_region_aff USING (request_id, item_id) LEFT JOIN t_session_sig USING (request_id, item_id)
LEFT JOIN t_copurchase USING (request_id, item_id)
""")
shared("t_net", """
SELECT *, round(boost - penalty, 6) AS net_score FROM (SELECT *,
  round(coalesce(history, 0) + coalesce(affinity, 0) + coalesce(industry, 0) + coalesce(region, 0) + coalesce(session_plus, 0) + coalesce(co_purchase, 0), 6) AS boost,
  round(coalesce(mismatch, 0) + coalesce(session_minus, 0), 6) AS penalty FROM t_factors)
""")


@query("history_boost", "SELECT * FROM t_history")
def history_boost(t):
    return P.history_boost(candidates(t), items(t)).where("history is not null").select("request_id", "item_id", "times", "history")


@query("category_affinity", "SELECT * FROM t_affinity")
def category_affinity(t):
    return P.category_affinity(candidates(t), categories(t)).where("affinity is not null").select("request_id", "item_id", "affinity")


shared("t_lately_aff", """
SELECT DISTINCT c.request_id, c.item_id, 0.25::DOUBLE AS industry FROM t_cands c JOIN t_likes_each l USING (request_id)
JOIN t_industry_categories i ON i.industry = l.industry AND i.category = c.category
WHERE c.user_id NOT IN (SELECT customer_id FROM t_purchases, t_as_of WHERE contract_date >= d - 180)
""")


@query("industry_affinity", "SELECT * FROM t_lately_aff")
def industry_affinity(t):
    """Every customer of the tables has bought once, so a user counts as new here without a contract in the last half year."""
    lately = t.purchases.where(F.col("contract_date") >= F.date_sub(as_of(t), 180)).select(F.col("customer_id").alias("user_id"))
    out = P.industry_affinity(interested(t), lately)
    return out.where("industry is not null").select("request_id", "item_id", "industry")


@query("mismatch_penalty", "SELECT * FROM t_mismatch")
def mismatch_penalty(t):
    return P.mismatch_penalty(interested(t)).where("mismatch is not null").select("request_id", "item_id", "mismatch")


@query("region_affinity", "SELECT * FROM t_region_aff")
def region_affinity(t):
    out = P.region_affinity(candidates(t), P.user_region(t.regional_facts, users(t)), t.regional_facts)
    return out.where("region is not null").select("request_id", "item_id", "regional_cnt", "region")


@query("session_event_boost", "SELECT * FROM t_session_sig WHERE session_plus > 0 OR session_minus > 0")
def session_event_boost(t):
    t.keep("user_events", "requests")
    signals = P.session_signals(t.user_events).where("session_plus > 0 or session_minus > 0")
    return N.met_signals([signals], t.requests, lexical_hits(t)).select("request_id", "item_id", "session_plus", "session_minus")


@query("co_purchase_boost", "SELECT * FROM t_copurchase")
def co_purchase_boost(t):
    hits = t.staged().stage("hits", lambda: lexical_hits(t))
    met = N.met_signals([neighbour_counts(t, hits)], t.requests, hits)
    return N.best_of_request(met, "neighbour_count", CO_PURCHASED).where("co_purchase is not null")


def neighbour_counts(t, hits):
    near = t.stage("near", lambda: P.neighbours(items(t), all_items(t)))
    return P.neighbour_counts(near, items(t), all_items(t), t.requests, hits)


def factors(t):
    """Lexical candidates with every personal factor."""
    from bidlens.plans import wide

    return wide.carried(t.staged(), lexical_hits(t), wide.FACTORS)


@query("net_score", """
SELECT request_id, item_id, boost, penalty, net_score, (history IS NOT NULL)::INT + (affinity IS NOT NULL)::INT + (industry IS NOT NULL)::INT
  + (mismatch IS NOT NULL)::INT + (region IS NOT NULL)::INT + (session_plus IS NOT NULL)::INT + (session_minus IS NOT NULL)::INT
  + (co_purchase IS NOT NULL)::INT AS n_factors FROM t_net
""")
def net_score(t):
    return factors(t).select("request_id", "item_id", "boost", "penalty", "net_score", F.size("explanations").alias("n_factors"))


shared("t_last_seen", "SELECT user_id, category, max(ts) AS last_at FROM t_events GROUP BY 1, 2")
shared("t_start_weights", "SELECT user_id, category, cnt / sum(cnt) OVER (PARTITION BY user_id) AS weight FROM t_user_cats")


@query("last_seen_category", "SELECT user_id, category, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM t_last_seen")
def last_seen_category(t):
    return P.last_seen_category(t.user_events).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query("decay_weights", """
SELECT user_id, category, round(coalesce(weight * pow(0.5, (epoch_us(now_ts) - epoch_us(last_at)) / 86400e6 / 14), weight), 6) AS weight
FROM t_start_weights LEFT JOIN t_last_seen USING (user_id, category), t_event_now
""")
def decay_weights(t):
    weights = P.category_weights(P.user_categories(all_items(t), t.catalog_base))
    return P.decay_weights(weights, P.last_seen_category(t.user_events), event_now(t))


shared("t_profile_vec", """
SELECT user_id, list(m ORDER BY pos) AS pv FROM (SELECT user_id, pos, sum(x * times) / sum(times) AS m FROM (
  SELECT user_id, times, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM t_user_items JOIN t_vectors USING (item_id))
  GROUP BY 1, 2) GROUP BY 1
""")


@query("user_profile", """
SELECT user_id, 'category' AS kind, category AS key, round(weight, 6) AS value FROM t_start_weights
UNION ALL SELECT user_id, 'vector', CAST(generate_subscripts(pv, 1) - 1 AS VARCHAR), round(unnest(list_transform(pv, lambda x: x / (sqrt(list_dot_product(pv, pv)) + 1e-9))), 6) FROM t_profile_vec
UNION ALL SELECT user_id, 'count', 'interactions', sum(times)::DOUBLE FROM t_user_items GROUP BY 1
UNION ALL SELECT user_id, 'count', 'positive_items', count(*)::DOUBLE FROM t_user_items GROUP BY 1
""")
def user_profile(t):
    own = cut_lineage(all_items(t).select("user_id", "item_id", "times"), "facts")  # counted once for all four kinds
    weights = P.category_weights(P.user_categories(own, t.catalog_base)).select(
        "user_id", F.lit("category").alias("kind"), F.col("category").alias("key"), F.round("weight", 6).alias("value")
    )
    vec = P.profile_vectors(own, t.item_vectors).select("user_id", F.posexplode("vector").alias("pos", "x")).select(
        "user_id", F.lit("vector").alias("kind"), F.col("pos").cast("string").alias("key"), F.round("x", 6).alias("value")
    )
    counts = P.profile_counts(own).select(
        "user_id", F.lit("count").alias("kind"),
        F.explode(F.create_map(
            F.lit("interactions"), F.col("interaction_count").cast("double"),
            F.lit("positive_items"), F.col("positive_items").cast("double"),
        )).alias("key", "value"),
    )
    return weights.unionByName(vec).unionByName(counts)


shared("t_folded", """
WITH s AS (SELECT user_id, category, ts, event_id, weight * 0.1 AS d FROM t_events JOIN t_actions ON action = event_type WHERE weight > 0),
  f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
          AND user_id NOT IN (SELECT user_id FROM t_start_weights) AS starts FROM s),
  g AS (SELECT *, sum(CASE WHEN starts THEN 0 ELSE ln(1 + d) END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS tail FROM f),
  a AS (SELECT user_id, category, CASE WHEN starts THEN 1 ELSE d END * exp(-tail) AS w FROM g
    UNION ALL SELECT w.user_id, w.category, weight * exp(-coalesce(x, 0)) FROM t_start_weights w
      LEFT JOIN (SELECT user_id, max(tail) AS x FROM g GROUP BY 1) USING (user_id))
SELECT user_id, category, round(sum(w), 6) AS weight FROM a GROUP BY 1, 2
""")


def folded(t):
    def build():
        start = P.category_weights(P.user_categories(all_items(t), t.catalog_base))
        return P.profile_update_weights(start, t.user_events, actions(t))

    return t.stage("weights", build)


@query("profile_update_weights", "SELECT * FROM t_folded")
def profile_update_weights(t):
    return folded(t)


@query("profile_update_embedding")
def profile_update_embedding(t):
    out = P.profile_update_embedding(P.profile_vectors(all_items(t), t.item_vectors), t.user_events, t.item_vectors, actions(t))
    return out.select("user_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


shared("t_sets", """
WITH s AS (SELECT user_id, item_id, ts, event_id, event_type = 'bounce' AS bad FROM t_events WHERE event_type IN ('bounce', 'click', 'compare'))
SELECT user_id, item_id, bool_or(NOT bad) AS is_positive, arg_max(bad, (ts, event_id)) AS is_negative,
  count(*) FILTER (NOT bad AND (lb IS NULL OR ts > lb)) AS session_clicks
FROM (SELECT *, max(ts) FILTER (bad) OVER (PARTITION BY user_id, item_id) AS lb FROM s) GROUP BY 1, 2
""")


@query("profile_update_sets", "SELECT * FROM t_sets")
def profile_update_sets(t):
    return P.profile_update_sets(t.user_events)


shared("t_marks", """
SELECT coalesce(b.user_id, s.user_id) AS user_id, coalesce(b.item_id, s.item_id) AS item_id,
  b.item_id IS NOT NULL OR coalesce(is_positive, false) AS is_positive, coalesce(is_negative, false) AS is_negative
FROM t_user_items b FULL JOIN t_sets s ON s.user_id = b.user_id AND s.item_id = b.item_id
""")
shared("t_rerank", """
SELECT request_id, item_id, round(p, 8) AS personal_score, round(base_score + round(p, 8), 8) AS final_score, concat_ws('|',
  CASE WHEN weight IS NOT NULL THEN 'Matches your frequent category ''' || category || ''' (' || CAST(floor(weight * 100 + 1e-9) AS INT) || '% of purchases)' END,
  CASE WHEN sim > 0.5 THEN 'Similar to your purchase history profile' END,
  CASE WHEN is_positive THEN 'Previously purchased item' END,
  CASE WHEN is_negative THEN 'Ranked lower: you quickly returned from this item' END) AS reasons
FROM (SELECT *, coalesce(weight * 0.3, 0) + coalesce(sim * 0.15, 0) + CASE WHEN is_positive THEN 0.09 ELSE 0 END - CASE WHEN is_negative THEN 0.24 ELSE 0 END AS p
  FROM (SELECT c.*, w.weight, m.is_positive, m.is_negative, list_dot_product(pv, vector) / (sqrt(list_dot_product(pv, pv)) + 1e-9) AS sim
    FROM t_cands c LEFT JOIN t_folded w USING (user_id, category) LEFT JOIN t_profile_vec USING (user_id)
    LEFT JOIN t_vectors v USING (item_id) LEFT JOIN t_marks m USING (user_id, item_id)))
""")


def item_sets(t):
    return t.stage("item-sets", lambda: P.profile_update_sets(t.user_events))


def marks(t, own):
    sets = item_sets(t)
    return own.select("user_id", "item_id", F.lit(True).alias("b")).join(sets, ["user_id", "item_id"], "full").select(
        "user_id", "item_id",
        (F.coalesce("b", F.lit(False)) | F.coalesce("is_positive", F.lit(False))).alias("is_positive"),
        F.coalesce("is_negative", F.lit(False)).alias("is_negative"),
    )


@query("profile_rerank", "SELECT * FROM t_rerank")
def profile_rerank(t):
    from bidlens.plans import wide

    out = wide.carried(t.staged(), lexical_hits(t), wide.PROFILE)
    return out.select("request_id", "item_id", "personal_score", "final_score", F.array_join("reasons", "|").alias("reasons"))


@query("profile_summary", """
WITH top AS (SELECT user_id, string_agg(category || '=' || printf('%.3f', w), '|' ORDER BY rn) AS tops FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, category) AS rn FROM (SELECT user_id, category, round(weight, 3) AS w FROM t_folded))
    WHERE rn <= 5 GROUP BY 1),
  tc AS (SELECT user_id, count(*) AS total_categories FROM t_folded GROUP BY 1),
  ct AS (SELECT user_id, sum(times)::BIGINT AS interaction_count, count(*) AS positive_items FROM t_user_items GROUP BY 1),
  st AS (SELECT user_id, count(*) FILTER (is_negative) AS negative_signals, sum(session_clicks)::BIGINT AS session_clicks FROM t_sets GROUP BY 1)
SELECT c_custkey AS user_id, CASE WHEN coalesce(total_categories, interaction_count, negative_signals) IS NULL THEN 'no_profile' ELSE 'active' END AS status,
  coalesce(tops, '') AS top_categories, coalesce(total_categories, 0) AS total_categories, coalesce(interaction_count, 0) AS interaction_count,
  coalesce(positive_items, 0) AS positive_items, coalesce(negative_signals, 0) AS negative_signals, coalesce(session_clicks, 0) AS session_clicks,
  pv IS NOT NULL AS has_embedding
FROM customer c LEFT JOIN top ON top.user_id = c_custkey LEFT JOIN tc ON tc.user_id = c_custkey LEFT JOIN ct ON ct.user_id = c_custkey
LEFT JOIN st ON st.user_id = c_custkey LEFT JOIN t_profile_vec v ON v.user_id = c_custkey
""")
def profile_summary(t):
    own = all_items(t)
    out = P.profile_summary(
        t.raw("customer").select(F.col("c_custkey").alias("user_id")), folded(t), P.profile_counts(own),
        P.profile_update_sets(t.user_events), P.profile_vectors(own, t.item_vectors),
    )
    return out.withColumn("top_categories", F.array_join("top_categories", "|"))


shared("t_interest", """
WITH j AS (SELECT user_id, category, coalesce(cnt, 0) AS cnt, coalesce(weight, 0) AS sw,
    coalesce(CAST(floor((epoch_us(now_ts) - epoch_us(last_at)) / 86400e6) AS BIGINT), 999) AS days
  FROM (SELECT user_id, category, cnt FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, category) AS rn FROM t_user_cats) WHERE rn <= 10)
  FULL JOIN t_folded USING (user_id, category) LEFT JOIN t_last_seen USING (user_id, category), t_event_now),
  w AS (SELECT user_id, category, cnt AS contract_count,
    round(least(1, least(cnt / 50.0, 1) * CAST(0.6 AS DOUBLE) + sw * 0.4) * (CAST(0.3 AS DOUBLE) + CAST(0.7 AS DOUBLE) * greatest(0, 1 - days / 30.0)), 3) AS weight,
    CASE WHEN sw > 0.3 AND days < 1 THEN 'rising' WHEN days > 14 THEN 'fading' ELSE 'stable' END AS trend,
    CASE WHEN days < 999 THEN days ELSE -1 END AS last_interaction_days FROM j),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, category) AS position,
    CASE WHEN trend = 'fading' THEN row_number() OVER (PARTITION BY user_id, trend ORDER BY weight DESC, category) END AS f FROM w)
SELECT user_id, category, contract_count, weight, trend, last_interaction_days, position,
  weight > 0.3 AND position <= 3 AS is_active, coalesce(f <= 2, false) AS is_fading FROM r WHERE position <= 8
""")


def interests(t):
    cats = P.user_categories(all_items(t), t.catalog_base)
    return P.interest_summary(cats, folded(t), P.last_seen_category(t.user_events), event_now(t))


@query("interest_summary", "SELECT * FROM t_interest")
def interest_summary(t):
    return interests(t)


@query("merge_session_interest", """
SELECT user_id, category, coalesce(n, 0) AS click_count, coalesce(contract_count, 0) AS contract_count,
  coalesce(weight, round(least(n * 0.1, 0.3), 6)) AS weight, CASE WHEN n > 0 THEN 'rising' ELSE trend END AS trend,
  CASE WHEN weight IS NULL THEN 0 ELSE last_interaction_days END AS last_interaction_days
FROM t_interest FULL JOIN (SELECT user_id, category, count(*) AS n FROM t_events, t_event_now
  WHERE event_type = 'click' AND ts >= now_ts - INTERVAL 1 DAY GROUP BY 1, 2) USING (user_id, category)
""")
def merge_session_interest(t):
    clicks = t.user_events.where("event_type = 'click'").where(F.col("ts") >= event_now(t) - F.expr("interval 1 day"))
    return P.merge_session_interest(interests(t), clicks)


@query("user_stats", """
SELECT user_id, total_contracts, tops AS top_categories FROM (SELECT user_id, sum(times)::BIGINT AS total_contracts FROM t_user_items GROUP BY 1)
JOIN (SELECT user_id, string_agg(category, '|' ORDER BY rn) AS tops FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, category) AS rn FROM t_user_cats) WHERE rn <= 6 GROUP BY 1) USING (user_id)
""")
def user_stats(t):
    own = all_items(t)
    out = P.user_stats(P.user_categories(own, t.catalog_base), own)
    return out.withColumn("top_categories", F.array_join("top_categories", "|"))


shared("t_allowed", """
SELECT user_id, category FROM t_profiles JOIN t_industry_categories USING (industry) UNION SELECT user_id, category FROM t_user_cats
""")


def allowed(t):
    return P.allowed_categories(t.profiles, P.user_categories(all_items(t), t.catalog_base), t.industry_categories)


@query("allowed_categories", "SELECT * FROM t_allowed")
def allowed_categories(t):
    return allowed(t)


@query("user_category_facets", """
SELECT user_id, category, cnt FROM t_allowed JOIN (SELECT category, count(*) AS cnt FROM t_items GROUP BY 1) USING (category)
""")
def user_category_facets(t):
    return P.user_category_facets(allowed(t), A.category_counts(t.catalog_base))
