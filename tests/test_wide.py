"""Signals packed into the rows of requests: the rows of joins per candidate, without a shuffle of candidates."""

import itertools

from pyspark.sql import functions as F

from bidlens.operators import notes as N
from bidlens.operators import personal as P
from bidlens.plans import wide
from bidlens.plans.q_retrieval import candidates, lexical_hits
from bidlens.plans import q_personal as QP
from bidlens.sources.adapters import Tables


def tables(spark):
    requests = spark.createDataFrame(
        [("1|a", 1, "s1", "a"), ("1|b", 1, "s2", "b"), ("2|a", 2, "s3", "a"), ("3|b", 3, None, "b")],
        "request_id string, user_id long, session_id string, query string")
    hits = spark.createDataFrame([("a", 10), ("a", 11), ("b", 11), ("b", 12)], "query string, item_id long")
    return requests, hits


def test_signals_meet_candidates_as_left_joins_do(spark):
    requests, hits = tables(spark)
    bought = spark.createDataFrame([(1, 11, 5), (2, 10, 1), (2, 99, 7), (None, 10, 3)], "user_id long, item_id long, times long")
    seen = spark.createDataFrame([(1, "s2", 11, 0.5), (1, "s1", 12, 0.7), (3, None, 11, 0.9)], "user_id long, session_id string, item_id long, plus double")
    met = N.met_signals([bought, seen], requests, hits)
    got = N.read_notes(requests.join(N.noted([met]), "request_id", "left").join(hits, "query"), ["times", "plus"])
    cands = requests.join(hits, "query")
    want = cands.join(bought, ["user_id", "item_id"], "left").join(seen, ["user_id", "session_id", "item_id"], "left")
    cols = ["request_id", "item_id", "times", "plus"]
    rows = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert rows(got) == rows(want) and len(rows(got)) == 8
    split = N.noted([N.met_signals([bought], requests, hits), N.met_signals([seen], requests, hits)])
    again = N.read_notes(requests.join(split, "request_id", "left").join(hits, "query"), ["times", "plus"])
    assert rows(again) == rows(want)


def test_neighbour_counts_of_usual_and_heavy_buyers(spark, monkeypatch):
    requests, hits = tables(spark)
    facts = spark.createDataFrame(
        [(u, i, d) for (u, i), d in zip(itertools.product((1, 2, 3, 4, 5), (10, 11, 12, 50, 51)), range(25)) if (u + i) % 3], "user_id long, item_id long, last_date int")
    cands = requests.join(hits, "query")
    own = facts.where("user_id < 4")
    want = sorted(map(tuple, P.co_purchase_boost(cands, own, facts, 3, 1).collect()))
    for limit in (1000, 1, 0):
        monkeypatch.setattr(P, "HEAVY_BUYER", limit)
        counts = P.neighbour_counts(P.neighbours(own, facts, 3), own, facts, requests, hits)
        best = N.best_of_request(N.met_signals([counts], requests, hits), "neighbour_count", 1).where("co_purchase is not null")
        assert sorted(map(tuple, best.select("request_id", "item_id", "neighbour_count", "co_purchase").collect())) == want and want


def test_candidates_are_not_shuffled_when_hits_are_small(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    out = wide.carried(t.staged(), lexical_hits(t), wide.FACTORS).select("request_id", "item_id", "net_score")
    assert out.count() == candidates(t).count() > 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("element_at")[0]  # from the output down to where the notes of a candidate are read
    assert "Join" not in above and "Aggregate" not in above and "Window" not in above
    factors = QP.factors(Tables(spark, "/root/testdata/sf0.001")).where(F.size("explanations") > 1)
    assert factors.count() > 100


def test_purchases_of_items_are_summed_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001").staged()
    out = wide.carried(t, lexical_hits(t), wide.FEATURES)
    assert out.count() > 1000 and "item-totals" in t._stages
    for df in (t.order_counts, t._stages["full-hits"]):  # both read the sums, neither the purchases
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert t.order_counts.count() == t.facts.select("item_id").distinct().count()
