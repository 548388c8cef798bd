"""Session, query-log and collective-learning state computed in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.operators.analytics import top_per_group


def clean_query(c: str) -> Column:
    return F.lower(F.trim(c))


def collective_patterns(events: DataFrame, min_users: int = 2) -> DataFrame:
    """(query, product) pairs clicked or liked by at least two distinct users.

    Users are counted per query as typed; forms that differ only in case or blanks keep the
    largest count.
    """
    chosen = events.where("event_type in ('click', 'like') and query is not null and query not in ('', '*')")
    typed = (
        chosen.groupBy("query", F.col("name").alias("product_name"))
        .agg(F.count_distinct("user_id").alias("user_count"))
    )
    return shown_patterns(typed, min_users)


def shown_patterns(typed: DataFrame, min_users: int = 2) -> DataFrame:
    """Patterns of enough users from counts per query as typed."""
    enough = typed.where(F.col("user_count") >= min_users)
    return enough.groupBy(clean_query("query").alias("query"), "product_name").agg(F.max("user_count").alias("user_count"))


def learned_rewrites(patterns: DataFrame, k: int = 3) -> DataFrame:
    """Top product names chosen for a query."""
    return top_per_group(patterns, "query", [F.desc("user_count"), "product_name"], k).select(
        "query", F.col("product_name").alias("rewrite"), "user_count", F.col("rn").alias("position")
    )


BOOSTED = ("click", "compare", "like", "view")
SESSION_GAP = 3600  # seconds
SIGNAL_CAP = 3


# ---- session counters --------------------------------------------------------------------
def signal(event_type: Column) -> Column:
    return F.when(event_type.isin(*BOOSTED), "boosted").otherwise("penalized")


def signed(events: DataFrame) -> DataFrame:
    return events.withColumn("sign", signal(F.col("event_type")))


def moved(events: DataFrame) -> DataFrame:
    """Events that move no category have none."""
    return events.withColumn("category", F.when(F.col("event_type").isin("click", "view", "like"), F.col("category")))


def per_kind(events: DataFrame, *fields: str) -> DataFrame:
    """Count and last time of each kind of event (``fields``) inside one activity window of (user, session).

    A window ends after SESSION_GAP without events; any event prolongs it. Events within one slot of that length always
    share a window, so they are counted by slot first, and windows are put together from the slots of a session: their
    number depends on how long it lasts, not on how many events it has.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withColumn(
        "slot", F.floor(F.unix_seconds("ts") / SESSION_GAP))
    counts = timed.groupBy("user_id", "session_id", "slot", *fields).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    slots = counts.groupBy("user_id", "session_id", "slot").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    order = W.partitionBy("user_id", "session_id").orderBy("slot")
    before = F.unix_micros(F.lag("last_at").over(order))
    opens = before.isNull() | (F.unix_micros("first_at") - before > SESSION_GAP * 1_000_000)
    starts = slots.withColumn("opened", F.when(opens, F.col("first_at"))).select(
        F.col("user_id").alias("_u"), F.col("session_id").alias("_s"), F.col("slot").alias("_slot"),
        F.max("opened").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("started_at"))
    on = F.col("user_id").eqNullSafe(F.col("_u")) & F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_slot"))
    return counts.join(starts, on).groupBy("user_id", "session_id", "started_at", *fields).agg(
        F.sum("n").alias("n"), F.max("last_at").alias("last_at"))


def counter_rows(kinds: DataFrame) -> DataFrame:
    return kinds.select(
        "user_id", "session_id", "item_id", "sign", "started_at", F.least("n", F.lit(SIGNAL_CAP).cast("long")).alias("cnt"), "last_at")


def momentum_rows(kinds: DataFrame) -> DataFrame:
    return kinds.where("category is not null").select("user_id", "session_id", "category", "started_at", "n", "last_at")


def session_counters(events: DataFrame) -> DataFrame:
    """Signals per (user, session, item, sign), at most three, inside one activity window of the session."""
    return counter_rows(per_kind(signed(events), "item_id", "sign"))


def newest(windows: DataFrame) -> DataFrame:
    """The rows of each session's newest activity window; older ones have expired."""
    last = windows.groupBy("user_id", "session_id").agg(F.max("started_at").alias("started_at"))
    return windows.join(last, ["user_id", "session_id", "started_at"], "left_semi")


def live_counters(counters: DataFrame) -> DataFrame:
    """The counters of every session's newest window."""
    return newest(counters).select("user_id", "session_id", "item_id", "sign", "cnt", "last_at")


def session_adjustments(counters: DataFrame) -> DataFrame:
    """+0.15 per boosting and -0.4 per penalising signal."""
    weight = F.when(F.col("sign") == "boosted", F.col("cnt") * 0.15).otherwise(F.col("cnt") * -0.4)
    return counters.groupBy("user_id", "session_id", "item_id").agg(F.round(F.sum(weight), 6).alias("session_delta"))


def session_change_reason(counters: DataFrame) -> DataFrame:
    """Counts of viewed and rejected items of a session, and the message shown for them."""
    n = counters.groupBy("user_id", "session_id").agg(
        F.count_if(F.col("sign") == "boosted").alias("boosted"),
        F.count_if(F.col("sign") == "penalized").alias("penalized"),
    )
    # fixed values: texts of the message
    part = lambda c, text: F.when(F.col(c) > 0, F.format_string(text, c))
    return n.withColumn(
        "reason",
        F.concat(
            F.lit("Выдача изменилась, потому что в этой сессии "),
            F.concat_ws(" и ", part("boosted", "вы просмотрели %d товар(ов)"), part("penalized", "отклонили %d товар(ов)")),
            F.lit("."),
        ),
    )


def strong_signals(counters: DataFrame, min_count: int = 2) -> DataFrame:
    """Items with repeated signals: (user, item, sign, last_at)."""
    return counters.where(F.col("cnt") >= min_count).groupBy("user_id", "item_id", "sign").agg(F.max("last_at").alias("last_at"))


def flush_strong_signals(existing: DataFrame, counters: DataFrame, keep: int = 200) -> DataFrame:
    """Merge strong session signals into the remembered ones; the most recent 200 per sign stay.

    Both sides are (user_id, item_id, sign, last_at) rows, which any later merge can extend.
    """
    merged = (
        existing.unionByName(strong_signals(counters))
        .groupBy("user_id", "sign", "item_id")
        .agg(F.max("last_at").alias("last_at"))
    )
    w = W.partitionBy("user_id", "sign").orderBy(F.desc("last_at"), "item_id")
    return merged.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)


def cross_session_adjustments(cands: DataFrame, remembered: DataFrame) -> DataFrame:
    """Adds ``cross_delta``: -0.5 for hidden items, else +0.2 for liked ones."""
    return cands.join(cross_deltas(remembered), ["user_id", "item_id"], "left")


def cross_deltas(remembered: DataFrame) -> DataFrame:
    hidden = F.max(F.col("sign") == "penalized")
    return remembered.groupBy("user_id", "item_id").agg(F.when(hidden, -0.5).when(~hidden, 0.2).alias("cross_delta"))


# ---- momentum ----------------------------------------------------------------------------
def category_momentum(events: DataFrame) -> DataFrame:
    """Clicks, views and likes per (session, category) inside one activity window of the session."""
    return momentum_rows(per_kind(moved(events), "category"))


def momentum_boost(cands: DataFrame, momentum: DataFrame) -> DataFrame:
    """Adds ``momentum``: share of the session's strongest category, times 0.3."""
    return cands.join(category_strength(momentum), ["user_id", "session_id", "category"], "left")


def category_strength(momentum: DataFrame) -> DataFrame:
    live = newest(momentum)
    peak = live.groupBy("user_id", "session_id").agg(F.max("n").alias("peak"))
    return live.join(peak, ["user_id", "session_id"]).select(
        "user_id", "session_id", "category", F.round(F.lit(0.3) * F.col("n") / F.col("peak"), 3).alias("momentum")
    )


# ---- likes -------------------------------------------------------------------------------
def like_dislike_state(events: DataFrame, now: Column, ttl_days: int = 7) -> DataFrame:
    """Latest of like and dislike per (user, item), kept while the user's list lives.

    A list of likes (or dislikes) dies when nothing has been added to it for seven days; what is added later starts it anew.
    """
    votes = events.where("event_type in ('like', 'dislike')")
    last = votes.groupBy("user_id", "item_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("last_at")
    )
    ttl = F.expr(f"interval {ttl_days} days")
    times = votes.select("user_id", F.col("event_type").alias("state"), "ts").distinct()
    before = F.lag("ts").over(W.partitionBy("user_id", "state").orderBy("ts"))
    lists = times.withColumn("fresh", before.isNull() | (F.col("ts") > before + ttl)).groupBy("user_id", "state").agg(
        F.max("ts").alias("touched"), F.max(F.when(F.col("fresh"), F.col("ts"))).alias("since")
    ).where(F.col("touched") >= now - ttl)
    on = last.user_id.eqNullSafe(lists.user_id) & (last.state == lists.state) & (last.last_at >= lists.since)
    return last.join(lists, on, "left_semi")


def like_dislike_boost(state: DataFrame) -> DataFrame:
    return state.select(
        "user_id", "item_id",
        F.when(F.col("state") == "like", 1.5 * 1.5).otherwise(-1.0 * 1.5).alias("like_delta"),
    )


def last_category_touch(events: DataFrame, now: Column, ttl_days: int = 60) -> DataFrame:
    touched = events.where("event_type in ('click', 'view', 'like', 'compare') and category is not null")
    return touched.groupBy("user_id", "category").agg(F.max("ts").alias("last_at")).where(
        F.col("last_at") >= now - F.expr(f"interval {ttl_days} days")
    )


# ---- query log ---------------------------------------------------------------------------
def asked(events: DataFrame) -> DataFrame:
    return events.withColumn("q", clean_query("query")).where("q is not null and q not in ('', '*')")


def popular_queries(events: DataFrame, top: int = 10) -> DataFrame:
    return asked(events).groupBy(F.col("q").alias("query")).agg(F.count("*").alias("cnt")).orderBy(
        F.desc("cnt"), "query"
    ).limit(top)


def recent_queries(events: DataFrame, now: Column, keep: int = 50, days: int = 30) -> DataFrame:
    """Last 50 queries per user, newest first, of users who asked in the last 30 days; older entries stay."""
    active = asked(events).groupBy("user_id").agg(F.max("ts").alias("last")).where(
        F.col("last") >= now - F.expr(f"interval {days} days"))
    rows = asked(events).join(active, "user_id", "left_semi")
    return top_per_group(rows, "user_id", [F.desc("ts"), F.desc("event_id")], keep).select(
        "user_id", F.col("q").alias("query"), F.col("rn").alias("position")
    )


def recent_distinct_queries(events: DataFrame, keep: int = 8) -> DataFrame:
    last = asked(events).groupBy("user_id", F.col("q").alias("query")).agg(
        F.max(F.struct("ts", "event_id")).alias("at")
    )
    return top_per_group(last, "user_id", [F.desc("at")], keep).select("user_id", "query", F.col("rn").alias("position"))


# ---- collective learning -----------------------------------------------------------------
def collective_insights(patterns: DataFrame, k: int = 5) -> DataFrame:
    return top_per_group(patterns, "query", [F.desc("user_count"), "product_name"], k)


def collective_boost(cands: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds ``collective``: the item has one of the five names most chosen for the query."""
    top = collective_insights(patterns).select(
        "query", F.col("product_name").alias("name"),
        F.round(F.least(F.col("user_count") * 0.15, F.lit(0.6)), 6).alias("collective"),
    )
    return cands.join(top, ["query", "name"], "left")


def collective_stats(patterns: DataFrame) -> DataFrame:
    per_query = patterns.groupBy("query").agg(
        F.max(F.struct("user_count", F.col("product_name").alias("name"))).alias("best")
    )
    return per_query.agg(
        F.count("*").alias("total_patterns"),
        F.max(F.struct(F.col("best.user_count").alias("users"), F.col("query").alias("query"), F.col("best.name").alias("product"))).alias("s"),
    ).select("total_patterns", F.col("s.query").alias("query"), F.col("s.product").alias("top_product"), F.col("s.users").alias("users"))


def interaction_history(events: DataFrame, n: int = 50) -> DataFrame:
    """Last n clicks and n most recent positive and negative items per user, as rows."""
    pick = lambda kinds, label: events.where(F.col("event_type").isin(*kinds)).select(
        "user_id", F.lit(label).alias("kind"), "item_id", "ts", "event_id"
    )
    clicks = top_per_group(pick(["click"], "click"), "user_id", [F.desc("ts"), F.desc("event_id")], n)
    signs = pick(["click", "compare"], "positive").unionByName(pick(["bounce"], "negative"))
    last = signs.groupBy("user_id", "kind", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    w = W.partitionBy("user_id", "kind").orderBy(F.desc("at"))
    signs_top = last.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    cols = ["user_id", "kind", "item_id", F.col("rn").alias("position")]
    return clicks.select(*cols).unionByName(signs_top.select(*cols))


def first_click_dedup(events: DataFrame) -> DataFrame:
    """One click per item and session, the first."""
    clicks = events.where("event_type = 'click'")
    return clicks.groupBy("user_id", "session_id", "item_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select(
        "user_id", "session_id", "item_id", F.col("f.event_id").alias("event_id")
    )


def bounce_detection(events: DataFrame, seconds: float = 4.0) -> DataFrame:
    """Opened items left for the next event of the session within ``seconds``."""
    w = W.partitionBy("user_id", "session_id").orderBy("ts", "event_id")
    nxt = F.lead("ts").over(w)
    gap = (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return (
        events.withColumn("open_seconds", gap)
        .where((F.col("event_type") == "click") & (F.col("open_seconds") < seconds))
        .select("user_id", "session_id", "item_id", "event_id", F.lit("bounce").alias("event_type"), "open_seconds")
    )
