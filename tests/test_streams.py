import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bidlens.operators import sessions as S
from bidlens.sources.files import event_source
from bidlens.streaming import events as E

SCHEMA = "event_id long, ts timestamp, user_id long, item_id long, event_type string, session_id string, query string, category string, name string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def event(i, at, user=1, item=5, kind="click", query="q", cat="C", name="N"):
    return (i, f"2024-01-01 {at}", user, item, kind, "s", query, cat, name)


def folder(spark, tmp_path, *files):
    base = f"{tmp_path}/in"
    for n, data in enumerate(files):
        rows(spark, data).coalesce(1).write.mode("append").parquet(base)
    return base


FIRST = [event(1, "08:00:00"), event(2, "08:10:00", kind="like"), event(3, "08:20:00", user=2)]
SECOND = [event(4, "12:00:00", kind="dislike"), event(5, "12:00:02", item=6), event(6, "12:00:03", item=7, kind="view")]
LATE = [event(7, "20:00:00", user=3), event(8, "09:00:00", user=9)]


def source(spark, base):
    return event_source(spark, base, rows(spark, FIRST).schema, files_per_trigger=1)


def day(i, days, user=1, item=5, kind="like", cat="C"):
    return (i, str(datetime(2024, 1, 1) + timedelta(days=days)), user, item, kind, "s", "q", cat, "N")


def picked(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_votes_and_touch_equal_batch(spark, tmp_path):
    base = folder(spark, tmp_path, FIRST, SECOND, LATE)
    batch, now = rows(spark, FIRST + SECOND + LATE), F.lit("2024-01-02").cast("timestamp")
    path = E.run_available(E.like_dislike_state(source(spark, base)), "update", "v")
    columns = ["user_id", "item_id", "state", "last_at"]
    assert picked(E.live_votes(spark, path, now), *columns) == picked(S.like_dislike_state(batch, now), *columns)
    touch = E.read_latest(spark, E.run_available(E.last_category_touch(source(spark, base)), "update", "t"), ["user_id", "category"])
    assert picked(touch, *touch.columns) == picked(S.last_category_touch(batch, now), *touch.columns)


def test_votes_and_touches_expire(spark, tmp_path):
    """Over months: a list that rests for more than a week starts anew, and state holds what is alive only."""
    rng, data = random.Random(9), []
    for k in range(360):
        data.append(day(k, k / 3 + rng.random() / 9, rng.randint(1, 6), rng.randint(1, 12), rng.choice(["like", "like", "dislike"]), rng.choice("CDE")))
    data += [day(900, 0, 7), day(901, 20, 7, 6), day(902, 60, 8, 5, "dislike"), day(903, 119, 8, 9, "like"), day(904, 118.5, None), day(905, 119.5, 3, None)]
    data.sort(key=lambda r: r[1])
    base = folder(spark, tmp_path, *[data[i: i + 61] for i in range(0, len(data), 61)])
    now = F.lit("2024-04-30 12:00:00").cast("timestamp")
    path = E.run_available(E.like_dislike_state(source(spark, base)), "update", "v")
    columns = ["user_id", "item_id", "state", "last_at"]
    want = picked(S.like_dislike_state(rows(spark, data), now), *columns)
    assert picked(E.live_votes(spark, path, now), *columns) == want and len(want) > 20
    assert not [r for r in want if r[0] == 7] and [r[1:3] for r in want if r[0] == 8] == [(9, "like")]
    plain = {}  # the same by hand
    for _, at, user, item, kind, *_ in data:
        last, since = plain.get((user, kind), (None, None))
        at = datetime.fromisoformat(at)
        plain[user, kind] = at, at if last is None or at - last > timedelta(days=7) else since
    alive = {k: v[1] for k, v in plain.items() if v[0] >= datetime(2024, 4, 30, 12) - timedelta(days=7)}
    latest = {(r[2], r[3]): (r[4], datetime.fromisoformat(r[1])) for r in data}
    assert want == sorted(((u, i, k, at) for (u, i), (k, at) in latest.items() if (u, k) in alive and at >= alive[u, k]), key=str)
    assert max(E.progress[path][1:]) < 150 and E.progress[path][-1] <= 130  # 7 users, 12 items, two lists and an alarm each
    touch_path = E.run_available(E.last_category_touch(source(spark, base), ttl_days=10), "update", "t")
    touch = E.read_latest(spark, touch_path, ["user_id", "category"]).where(F.col("last_at") >= now - F.expr("interval 10 days"))
    want = S.last_category_touch(rows(spark, data).where("event_type = 'like'"), now, 10)
    assert picked(touch, *touch.columns) == picked(want, *touch.columns)
    gone = [day(i, i, user=100 + i) for i in range(40)]
    base = folder(spark, tmp_path / "gone", *[gone[i: i + 8] for i in range(0, 40, 8)])
    path = E.run_available(E.last_category_touch(source(spark, base), ttl_days=3), "update", "t")
    assert E.progress[path][-1] <= 2 * 5  # of 40 users four or five have touched something in three days


def test_counts_and_patterns_equal_batch(spark, tmp_path):
    base = folder(spark, tmp_path, FIRST, SECOND, LATE)
    batch = rows(spark, FIRST + SECOND + LATE)
    counts = E.read_latest(spark, E.run_available(E.query_counts(source(spark, base)), "update", "q"), ["query"])
    assert counts.first().cnt == S.popular_queries(batch).first().cnt
    path = E.run_available(E.pattern_users(source(spark, base)), "update", "c")
    got = E.collective_patterns(E.read_latest(spark, path, ["query", "product_name", "range"]))
    assert picked(got, *got.columns) == picked(S.collective_patterns(batch), *got.columns)


def test_state_of_patterns_grows_with_patterns(spark, tmp_path):
    data = [event(1000 * p + u, "08:00:00", user=u * 40, query=f"q{p}", name=f"N{p}") for p in range(3) for u in range(700)]
    data += [event(9000, "08:01:00", user=80, query="q0", name="N0"), event(9001, "08:01:00", user=-5, query="q0", name="N0"), event(9002, "08:01:00", user=None)]
    base = folder(spark, tmp_path, data[:900], data[900:])
    path = E.run_available(E.pattern_users(source(spark, base)), "update", "c")
    got = E.collective_patterns(E.read_latest(spark, path, ["query", "product_name", "range"]))
    assert picked(got, *got.columns) == [("q0", "N0", 701), ("q1", "N1", 700), ("q2", "N2", 700)] == picked(S.collective_patterns(rows(spark, data)), *got.columns)
    assert E.progress[path][-1] <= 7  # 2,100 triples; three patterns in one or two ranges of users


def test_closed_sessions_equal_batch_and_late_events_drop(spark, tmp_path):
    base = folder(spark, tmp_path, FIRST, SECOND, [event(7, "20:00:00", user=3)], [event(8, "09:00:00", user=9)])
    got = E.read_slices(spark, E.run_available(E.session_counters(source(spark, base)), "append", "s"))
    keys = ["user_id", "session_id", "item_id", "sign", "cnt"]
    want = S.session_counters(rows(spark, FIRST + SECOND))
    assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect()))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_windows_count_without_lists(spark, tmp_path):
    """Counters and momentum of long sessions against plain Python, in batch and in a stream; no list of events is made."""
    rng = random.Random(5)
    start, data = datetime(2024, 1, 1), []
    for n, user in enumerate((1, 1, 1, None, 2)):
        at = start + timedelta(minutes=rng.randint(0, 90))
        for k in range(60):
            data.append((100 * n + k, str(at), user, rng.choice([5, 6, None]), rng.choice(["click", "like", "dislike", "view"]), "s" if n < 4 else None, "q", rng.choice(["C", "D", None]), "N"))
            at += rng.choice([timedelta(seconds=9), timedelta(hours=1), timedelta(hours=1, microseconds=1), timedelta(minutes=59)])
    counters, momentum = defaultdict(list), defaultdict(list)
    windows, last = {}, {}
    for _, at, user, item, kind, name, _, category, _ in sorted(data, key=lambda r: r[1].ljust(26, "0") if "." in r[1] else r[1] + ".000000"):
        at = datetime.fromisoformat(at)
        if (user, name) not in last or at - last[user, name] > timedelta(hours=1):
            windows[user, name] = at
        last[user, name] = at
        counters[user, name, item, "penalized" if kind == "dislike" else "boosted", windows[user, name]].append(at)
        if kind != "dislike" and category:
            momentum[user, name, category, windows[user, name]].append(at)
    text = lambda rows: sorted(map(str, rows))
    want = text((*k, min(len(v), 3), max(v)) for k, v in counters.items()), text((*k, len(v), max(v)) for k, v in momentum.items())
    batch = rows(spark, data)
    spans = batch.groupBy("user_id", "session_id", F.session_window("ts", "1 hour").alias("w")).count()
    assert text(tuple(r) for r in spans.select("user_id", "session_id", "w.start").collect()) == text({(k[0], k[1], k[4]) for k in counters})
    for op, expected in zip((S.session_counters, S.category_momentum), want):
        assert "collect_list" not in plan(op(batch))
        assert text(tuple(r) for r in op(batch).collect()) == expected
    ordered = sorted(data, key=lambda r: datetime.fromisoformat(r[1]))
    end = (999, "2024-03-01 00:00:00", 77, 5, "click", "end", "q", "C", "N")
    base = folder(spark, tmp_path, ordered[:150], ordered[150:], [end])
    for op, label, expected in zip((E.session_counters, E.category_momentum), ("c", "m"), want):
        stream = op(source(spark, base))
        assert "collect_list" not in plan(stream)
        assert text(tuple(r) for r in E.read_slices(spark, E.run_available(stream, "append", label)).drop("batch").collect()) == expected


END = [event(99, "23:00:00", user=50)]  # lets the watermark pass what came before


def test_bounce_across_batches(spark, tmp_path):
    base = folder(spark, tmp_path, [event(1, "08:00:00")], [event(2, "08:00:03", item=6), event(3, "08:00:08", item=7)], END)
    got = E.read_slices(spark, E.run_available(E.bounce_detection(source(spark, base)), "append", "b"))
    assert [(r.item_id, r.open_seconds) for r in got.collect()] == [(5, 3.0)]


def test_bounces_equal_batch_with_rows_one_batch_late(spark, tmp_path):
    """Events of a batch may be older than those of the one before; order is restored, and no state is left behind."""
    rng, data = random.Random(3), []
    at = datetime(2024, 1, 1, 8)
    for k in range(400):
        at += timedelta(seconds=rng.choice([0.5, 2, 3.999999, 4, 30, 200]))
        data.append((k, str(at), rng.choice([1, 2]), rng.choice([5, 6, None]), rng.choice(["click", "click", "view"]), rng.choice(["s", "r"]), "q", "C", "N"))
    order = sorted(data, key=lambda r: (datetime.fromisoformat(r[1]) + timedelta(minutes=rng.random() * 25)))
    base = folder(spark, tmp_path, *[order[i: i + 67] for i in range(0, 400, 67)], END)
    path = E.run_available(E.bounce_detection(source(spark, base)), "append", "b")
    columns = ["user_id", "session_id", "item_id", "event_id", "open_seconds"]
    want = picked(S.bounce_detection(rows(spark, data)), *columns)
    assert picked(E.read_slices(spark, path), *columns) == want and len(want) > 30
    assert E.progress[path][-1] <= 2  # only the last event of the stream still waits
    late = [event(2, "10:00:00", item=6, kind="view"), event(3, "10:00:32", item=7, kind="view"), event(4, "10:00:30")]
    base = folder(spark, tmp_path / "late", late[:2], late[2:], END)
    got = E.read_slices(spark, E.run_available(E.bounce_detection(source(spark, base)), "append", "b"))
    assert [tuple(r) for r in got.select("item_id", "event_id", "open_seconds").collect()] == [(5, 4, 2.0)]


def test_invalid_events_are_kept_aside(spark, tmp_path):
    bad = [event(10, "08:00:00", kind="dance"), event(11, "08:00:01", user=None), event(12, "08:00:02", item=None)]
    base = folder(spark, tmp_path, [*FIRST, bad[0]], bad[1:])
    path, aside = E.run_validated(source(spark, base), "e")
    ids = lambda p: sorted(r.event_id for r in E.read_slices(spark, p).collect())
    assert ids(path) == [1, 2, 3] and ids(aside) == [10, 11, 12]


def test_state_of_sessions_is_kept_per_user(spark, tmp_path):
    data = [(100 * u + n, f"2024-01-{n + 1:02d} 08:00:00", u, 5, "click", f"s{n}", "q", "C", "N") for u in (1, 2) for n in range(25)]
    data += [(900 + n, "2024-01-03 09:00:00", None, 5, "click", s, "q", "C", "N") for n, s in enumerate(("a", "b", None))]
    base = folder(spark, tmp_path, data, [(999, "2024-03-01 08:00:00", 3, 5, "click", "z", "q", "C", "N")])
    path = E.run_available(E.session_counters(source(spark, base)), "append", "s")
    keys = ["user_id", "session_id", "item_id", "sign", "started_at", "cnt", "last_at"]
    assert picked(E.read_slices(spark, path), *keys) == picked(S.session_counters(rows(spark, data)), *keys)
    assert E.progress[path][0] == 5  # two users, and two sessions and one without id of no user; 53 sessions in all
