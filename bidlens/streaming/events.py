"""Structured Streaming twins of the session and query-log operators.

Every function takes the event stream with an event-time ``ts`` and returns a streaming frame;
:func:`run_available` writes it to a table of micro-batch slices that a retry overwrites, so
results are exactly-once. State lives in the state store under the shared checkpoint folder.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bidlens.operators import sessions as S
from bidlens.session import work_path
from bidlens.sources.cleaning import validated_events
from bidlens.streaming.stateful import Bounces, Touches, Votes

LATENESS = 3600  # seconds
WATERMARK = f"{LATENESS} seconds"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
progress: dict[str, list[int]] = {}  # rows of state after each batch, by the folder of a run


def with_event_time(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Watermarks need a timestamp with time zone; events later than ``delay`` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def closed_kinds(events: DataFrame, *fields: str) -> DataFrame:
    """Stream twin of ``per_kind``: its rows for every window that the watermark has passed.

    The state of a user holds, per open window of a session, the count and last time of each kind, never the events; calls and
    states are per user (per session where there is no user), as a user's many short sessions would cost a call each. The watermark runs on the end of the window that an event alone would open, so events are late when that window is closed.
    """
    gap = S.SESSION_GAP * 1_000_000

    def joined(windows: list) -> list:
        """Windows [first, last, {kind: [n, last]}] in order, with those less than a gap apart as one."""
        out: list = []
        for first, last, kinds in sorted(windows, key=lambda w: w[0]):
            if not out or first - out[-1][1] > gap:
                out.append([first, last, kinds])
                continue
            out[-1][1] = max(out[-1][1], last)
            for kind, (n, at) in kinds.items():
                own = out[-1][2].setdefault(kind, [0, at])
                own[0], own[1] = own[0] + n, max(own[1], at)
        return out

    def step(key, batches, state: GroupState):
        sessions = dict(json.loads(state.get[0])) if state.exists else {}
        for frame in batches:
            fresh: dict = {}
            for session, us, kind in zip(frame["session_id"].tolist(), frame["us"].tolist(), frame["kind"]):
                fresh.setdefault(None if pd.isna(session) else session, []).append([us, us, {kind: [1, us]}])
            for session, windows in fresh.items():
                sessions[session] = joined(sessions.get(session, []) + windows)
        passed = state.getCurrentWatermarkMs()
        open_ = [(s, kept) for s, windows in sessions.items() if (kept := [w for w in windows if w[1] + gap > passed * 1000])]
        if open_:
            state.update((json.dumps(open_),))
            first = min(w[1] for _, windows in open_ for w in windows)
            state.setTimeoutTimestamp(max(-(-(first + gap) // 1000) - 1, passed + 1))
        elif state.exists:
            state.remove()
        out = [(key[0], s, kind, w[0], n, at) for s, windows in sessions.items() for w in windows
               if w[1] + gap <= passed * 1000 for kind, (n, at) in w[2].items()]
        if out:
            yield pd.DataFrame(out, columns=["user_id", "session_id", "kind", "first", "n", "last"])

    ts = F.col("ts").cast("timestamp")
    keyed = events.where(ts.isNotNull()).select(
        "user_id", "session_id", F.to_json(F.struct(*fields)).alias("kind"), F.unix_micros(ts).alias("us"),
        (ts + F.make_dt_interval(secs=F.lit(S.SESSION_GAP))).alias("until"),
    ).withWatermark("until", f"{LATENESS + S.SESSION_GAP} seconds")
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    lone = F.when(F.col("user_id").isNull(), F.col("session_id"))  # rows without a user are no single group
    closed = keyed.withColumn("lone", lone).groupBy("user_id", "lone").applyInPandasWithState(
        step, f"user_id {types['user_id']}, session_id {types['session_id']}, kind string, first long, n long, last long",
        "windows string", "append", GroupStateTimeout.EventTimeTimeout,
    )
    kind = F.from_json("kind", ", ".join(f"{f} {types[f]}" for f in fields))
    return closed.withColumn("kind", kind).select(
        "user_id", "session_id", F.timestamp_micros("first").alias("started_at"), "kind.*", "n", F.timestamp_micros("last").alias("last_at"))


def session_counters(events: DataFrame) -> DataFrame:
    """Closed activity windows per (user, session, item, sign), counts capped at three."""
    return S.counter_rows(closed_kinds(S.signed(events), "item_id", "sign"))


def category_momentum(events: DataFrame) -> DataFrame:
    return S.momentum_rows(closed_kinds(S.moved(events), "category"))


def keyed_rows(events: DataFrame, *columns: str) -> DataFrame:
    """Events with the columns of a stateful processor: microseconds ``us`` next to the watermarked ``ts``."""
    dated = with_event_time(events.where("ts is not null"))
    return dated.select(*columns, F.unix_micros("ts").alias("us"), "ts")


def like_dislike_state(events: DataFrame, ttl_days: int = 7) -> DataFrame:
    """Changed votes per (user, item) and touched lists per user (rows without item, with their start); see :class:`Votes`."""
    votes = keyed_rows(events.where("event_type in ('like', 'dislike')").withColumn("state", F.col("event_type")), "user_id", "item_id", "state", "event_id")
    user = events.schema["user_id"].dataType.simpleString()
    return votes.groupBy("user_id").transformWithStateInPandas(
        Votes(ttl_days), f"user_id {user}, item_id long, state string, us long, since long", "update", "EventTime")


def live_votes(spark: SparkSession, path: str, now, ttl_days: int = 7) -> DataFrame:
    """Votes of the lists that live at ``now``, from the slices of :func:`like_dislike_state`."""
    rows = read_slices(spark, path)
    latest = lambda keys, values: rows.where(F.col("since").isNull() if "item_id" in keys else F.col("since").isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct("batch", "us")).alias("r")).select(*keys, "r.*")
    votes = latest(["user_id", "item_id"], ["state", "us"])
    lists = latest(["user_id", "state"], [F.col("us").alias("last"), "since"]).where(
        F.timestamp_micros("last") >= now - F.expr(f"interval {ttl_days} days"))
    return votes.join(lists, (votes.user_id.eqNullSafe(lists.user_id)) & (votes.state == lists.state) & (votes.us >= lists.since), "left_semi").select(
        "user_id", "item_id", "state", F.timestamp_micros("us").alias("last_at"))


def last_category_touch(events: DataFrame, ttl_days: int = 60) -> DataFrame:
    """Changed last touches per (user, category); forgotten after ``ttl_days``."""
    touched = events.where("event_type in ('click', 'view', 'like', 'compare') and category is not null")
    user = events.schema["user_id"].dataType.simpleString()
    return keyed_rows(touched, "user_id", "category").groupBy("user_id").transformWithStateInPandas(
        Touches(ttl_days), f"user_id {user}, category string, us long", "update", "EventTime",
    ).select("user_id", "category", F.timestamp_micros("us").alias("last_at"))


def query_counts(events: DataFrame) -> DataFrame:
    return S.asked(events).groupBy(F.col("q").alias("query")).agg(F.count("*").alias("cnt"))


def pattern_users(events: DataFrame) -> DataFrame:
    """Users of every (query, product) as bitmaps, one per range of user ids; exact and mergeable.

    State grows with patterns and ranges of users, not with (query, product, user); a pattern that a third of all users
    chose lies in many ranges, so in many tasks.
    """
    chosen = events.where("event_type in ('click', 'like') and query is not null and query not in ('', '*')").withColumn("user", F.col("user_id").cast("long"))
    return chosen.groupBy("query", F.col("name").alias("product_name"), F.bitmap_bucket_number("user").alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user")).alias("users"))


def collective_patterns(latest: DataFrame) -> DataFrame:
    """Patterns of at least two users, from the newest bitmaps of :func:`pattern_users`."""
    users = latest.groupBy("query", "product_name").agg(F.sum(F.bitmap_count("users")).alias("user_count"))
    return S.shown_patterns(users)


def first_click_dedup(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arriving click per (user, session, item) within the watermark."""
    clicks = with_event_time(events.where("event_type = 'click'"), delay)
    return clicks.dropDuplicatesWithinWatermark(["user_id", "session_id", "item_id"]).select(
        "user_id", "session_id", "item_id", "event_id"
    )


def bounce_detection(events: DataFrame, seconds: float = 4.0) -> DataFrame:
    """Opened items left for the next event of the session within ``seconds``; see :class:`Bounces`.

    Rows come out once the watermark has passed the next event, so events may arrive out of order by up to its delay.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    lone = F.when(F.col("user_id").isNull(), F.col("session_id"))  # rows without a user are no single group
    keyed = keyed_rows(events.withColumn("lone", lone), "user_id", "lone", "session_id", "item_id", "event_id", "event_type")
    return keyed.groupBy("user_id", "lone").transformWithStateInPandas(
        Bounces(seconds), f"user_id {types['user_id']}, session_id {types['session_id']}, item_id long, event_id long, open_seconds double",
        "append", "EventTime")


# ---- running -----------------------------------------------------------------------------
def run_available(stream: DataFrame, mode: str, label: str, shape=None, numbered=None) -> str:
    """Process everything that is available; returns the folder of micro-batch slices.

    ``shape(batch)`` or ``numbered(batch, number)`` say what of a batch is written.
    """
    spark = stream.sparkSession
    path = work_path(spark, label)

    def save(batch: DataFrame, number: int) -> None:
        out = numbered(batch, number) if numbered else shape(batch) if shape else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)  # maps and timers need it, and state then is not bound to the heap
    try:
        run = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", work_path(spark, f"{label}-state"))
            .trigger(availableNow=True)
            .foreachBatch(save)
            .start()
        )
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    run.awaitTermination()
    progress[path] = [sum(op.numRowsTotal for op in p.stateOperators) for p in run.recentProgress]
    return path


def run_validated(stream: DataFrame, label: str) -> tuple[str, str]:
    """Process what is available into two tables of slices: valid events, and the quarantined rest."""
    spark = stream.sparkSession
    aside = work_path(spark, f"{label}-quarantine")

    def valid(batch: DataFrame, number: int) -> DataFrame:
        ok, rest = validated_events(batch)
        rest.write.mode("overwrite").parquet(f"{aside}/batch={number}")
        return ok

    return run_available(stream, "append", label, numbered=valid), aside


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of every key of an update-mode table."""
    rows = read_slices(spark, path)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
