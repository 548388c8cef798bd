import math
import random

from pyspark.sql import functions as F

from bidlens.functions import dicts
from bidlens.operators import analytics as A
from bidlens.operators import metrics as M
from bidlens.operators import personal as P
from bidlens.operators import ranking as K
from bidlens.operators import retrieval as R
from bidlens.operators import sessions as S
from bidlens.operators import training as T
from bidlens.operators import vectorcells as C2
from bidlens.sources import cleaning as C
from bidlens.sources import files as S2


def test_price_info_edges(spark):
    rows = [(1, "10.00", "2019-10-01"), (1, "30.00", "2020-06-01"), (2, "5.00", "2020-06-01"), (3, "0.00", "2020-06-01"),
            (3, None, "2020-06-01"), (4, "1.00", "2019-01-01"), (4, "1.00", "2019-01-02")]
    df = spark.createDataFrame(rows, "item_id long, cost string, contract_date string").select(
        "item_id", F.col("cost").cast("decimal(15,2)").alias("cost"), F.col("contract_date").cast("date").alias("contract_date")
    )
    out = {r.item_id: (r.avg_price, r.price_trend) for r in A.price_info(df, F.lit("2020-06-10").cast("date")).collect()}
    # item 1: recent average 30 against 20 overall; item 2 has one contract, item 3 no priced one
    assert out == {1: (20.0, "up"), 4: (1.0, "stable")}


def test_bm25_keeps_ties_and_matches_formula(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a"]), (4, ["c", "a", "a"])], "item_id long, tokens array<string>")
    p = R.term_postings(docs, "item_id", "tokens")
    index = R.bm25_index(p, R.corpus_stats(docs, p), "item_id")
    terms = spark.createDataFrame([("q", "a")], "query string, term string")
    full = {r.item_id: r.score for r in R.bm25_scores(terms, index, "item_id").collect()}
    idf = math.log((4 - 4 + 0.5) / (4 + 0.5) + 1)
    for item, tf, dl in [(1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 2, 3)]:
        want = idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 1.75))
        assert abs(full[item] - want) < 1e-6
    top = {r.item_id for r in R.bm25_score(terms, index, "item_id", 2).collect()}
    assert top == {2, 3, 4} or full[4] < full[2]


def test_vector_topk_in_many_cells(spark):
    random.seed(1)
    vec = {i: [random.uniform(-1, 1) for _ in range(4)] for i in range(40)}
    items = spark.createDataFrame(list(vec.items()), "item_id long, vector array<double>")
    queries = items.withColumnRenamed("item_id", "query")
    got = C2.cell_topk(queries.withColumn("k", F.lit(3)), C2.build_cells(items, per_cell=5)).collect()
    for q in vec:
        order = sorted(vec, key=lambda i: (-round(sum(a * b for a, b in zip(vec[q], vec[i])), 6), i))[:3]
        assert [r.item_id for r in sorted((r for r in got if r.query == q), key=lambda r: r.rn)] == order


def test_profile_fold_equals_stepwise(spark):
    random.seed(2)
    weights = dict(dicts.ACTION_WEIGHTS)
    start = {1: {"A": 0.5, "B": 0.5}, 2: {}}
    events, n = [], 0
    for user in (1, 2, 3):
        for day in range(1, 4):
            for _ in range(6):
                n += 1
                events.append((n, f"2024-01-0{day} {random.randrange(24):02d}:00:00", user, random.choice(["click", "view", "bounce", "compare"]), random.choice("ABC")))
    df = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, category string").withColumn("ts", F.col("ts").cast("timestamp"))
    init = spark.createDataFrame([(u, c, w) for u, m in start.items() for c, w in m.items()], "user_id long, category string, weight double")
    acts = spark.createDataFrame(dicts.ACTION_WEIGHTS, "action string, weight double")
    got = {(r.user_id, r.category): r.weight for r in P.profile_update_weights(init, df, acts).collect()}
    for user in (1, 2, 3):
        w = dict(start.get(user, {}))
        for _, _, u, kind, cat in sorted(events, key=lambda e: (e[1], e[0])):
            if u == user and weights.get(kind, 0) > 0:
                w[cat] = w.get(cat, 0) + weights[kind] * 0.1
                total = sum(w.values())
                w = {k: v / total for k, v in w.items()}
        for cat, v in w.items():
            assert abs(got[(user, cat)] - v) < 2e-6


def test_embedding_fold_equals_stepwise(spark):
    import numpy as np

    vec = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.6, 0.8]}
    events = [(1, "2024-01-01", 7, "click", 1), (2, "2024-01-02", 7, "view", 2), (3, "2024-01-03", 7, "bounce", 3), (4, "2024-01-04", 7, "click", 3), (5, "2024-01-01", 8, "click", 2)]
    df = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, item_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    vectors = spark.createDataFrame(list(vec.items()), "item_id long, vector array<double>")
    init = spark.createDataFrame([(7, [0.8, 0.6])], "user_id long, vector array<double>")
    acts = spark.createDataFrame(dicts.ACTION_WEIGHTS, "action string, weight double")
    got = {r.user_id: r.vector for r in P.profile_update_embedding(init, df, vectors, acts).collect()}
    state = np.array([0.8, 0.6])
    for item in (1, 2, 3):
        state = 0.9 * state + 0.1 * np.array(vec[item])
        state /= np.linalg.norm(state) + 1e-9
    assert np.allclose(got[7], state) and got[8] == vec[2]


def test_neighbours_match_brute_force(spark):
    random.seed(3)
    facts = sorted({(random.randrange(30), random.randrange(8)) for _ in range(120)})
    rows = [(u, i, 1, f"2024-01-{random.randrange(1, 29):02d}") for u, i in facts]
    df = spark.createDataFrame(rows, "user_id long, item_id long, times long, last_date string")
    got = {}
    for r in P.neighbours(df, df, 4).collect():
        got.setdefault(r.user_id, set()).add(r.neighbour_id)
    for u in {r[0] for r in rows}:
        mine = {i for v, i in facts if v == u}
        key = {}
        for v, i, _, d in rows:
            if v != u and i in mine:
                key[v] = max(key.get(v, ""), d)
        want = [v for v, _ in sorted(key.items(), key=lambda e: (tuple(-ord(c) for c in e[1]), e[0]))[:4]]
        assert got.get(u, set()) == set(want)


def test_co_purchase_paths_agree(spark, monkeypatch):
    random.seed(4)
    rows = sorted({(random.randrange(20), random.randrange(15)) for _ in range(120)})
    df = spark.createDataFrame([(u, i, 1, "2024-01-01") for u, i in rows], "user_id long, item_id long, times long, last_date string")
    cands = spark.createDataFrame([(f"r{u}", u, i) for u in range(5) for i in range(15)], "request_id string, user_id long, item_id long")
    listed = sorted(map(tuple, P.co_purchase_boost(cands, df, df).collect()))
    monkeypatch.setattr(P, "HEAVY_BUYER", 3)
    assert listed == sorted(map(tuple, P.co_purchase_boost(cands, df, df).collect())) and listed


def test_facets_take_largest_free_match(spark):
    counts = spark.createDataFrame([("Paper", 5), ("Paper white", 9), ("Tools", 1)], "category string, cnt long")
    allowed = spark.createDataFrame([(1, "paper"), (1, "paper white box"), (1, "tool")], "user_id long, category string")
    got = {(r.category, r.cnt) for r in P.user_category_facets(allowed, counts).collect()}
    assert got == {("Paper white", 9), ("Paper", 5), ("Tools", 1)}


def test_name_bonus_positions(spark):
    cases = [("red bolt", "red", 1.0), ("bolts red", "bolt", 0.95), ("xbolt", "bolt", 1.0), ("a bolt b", "bolty", 0.0), ("steel nut gear", "nut box", (0.42 + 0) / 2), ("", "x", 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "name string, query string")
    got = [r.name_bonus for r in K.with_name_bonus(df).collect()]
    want = [1.0, 1.0, 1.0, 0.0, 0.21, 0.0]
    assert got == want


def test_paging_partitions_the_ranking(spark):
    rows = [("r", i, f"n{i % 3}", float(i % 4), i, [("profile_mismatch", -0.65)] if i % 5 == 0 else [], "relevance") for i in range(20)]
    df = spark.createDataFrame(rows, "request_id string, item_id long, name string, score double, order_count long, explanations array<struct<factor:string,weight:double>>, sort_by string")
    ranked = K.final_order(df)
    pages = [
        {r.item_id for r in K.paginate(ranked.withColumn("offset", F.lit(o)).withColumn("limit", F.lit(7))).collect()} for o in (0, 7, 14)
    ]
    assert set().union(*pages) == set(range(20)) and sum(map(len, pages)) == 20
    last = sorted(ranked.collect(), key=lambda r: r.position)[-4:]
    assert all(r.item_id % 5 == 0 for r in last)


def test_metrics_edges(spark):
    lists = {"ideal": [4, 2, 1], "none": [0, 0], "late": [0, 0, 3]}
    rows = [("x", q, i + 1, r) for q, rels in lists.items() for i, r in enumerate(rels)]
    j = spark.createDataFrame(rows, "run string, query_id string, rank int, rel int")
    ndcg = {r.query_id: r.ndcg_10 for r in M.dcg_ndcg_linear(j).collect()}
    assert ndcg["ideal"] == 1.0 and ndcg["none"] == 0.0 and abs(ndcg["late"] - 0.5) < 1e-6
    rr = {r.query_id: r.rr for r in M.reciprocal_rank(j).collect()}
    assert rr["late"] == 1 / 3 and rr["none"] == 0.0
    ap = {r.query_id: r.ap for r in M.average_precision(j).collect()}
    assert ap["ideal"] == 1.0 and abs(ap["late"] - 1 / 3) < 1e-12


def test_session_gap_and_cap(spark):
    times = ["10:00:00", "10:10:00", "10:20:00", "10:30:00", "11:30:00", "12:30:01"]
    df = spark.createDataFrame([(i, f"2024-01-01 {t}", 1, "s", 5, "click") for i, t in enumerate(times)], "event_id long, ts string, user_id long, session_id string, item_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted(r.cnt for r in S.session_counters(df).collect())
    assert got == [1, 3]  # five events up to 11:30:00 count as three; one second more starts anew


def test_latest_vote_wins(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 1, 5, "like"), (2, "2024-01-02", 1, 5, "dislike"), (3, "2024-01-03", 1, 5, "like"), (4, "2023-01-03", 2, 5, "like")], "event_id long, ts string, user_id long, item_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit("2024-01-04").cast("timestamp")
    assert [(r.user_id, r.state) for r in S.like_dislike_state(df, now).collect()] == [(1, "like")]


def test_attributes_and_casts(spark):
    df = spark.createDataFrame([("a:1; b:2; a:1",), ('{"k": "v"}',), ("plain",), (None,), ("x:1;x:2",)], "a string")
    got = [r.m for r in df.select(C.parse_attributes(F.col("a")).alias("m")).collect()]
    assert got == [{"a": "1", "b": "2"}, {"k": "v"}, {"raw": "plain"}, {}, {"x": "2"}]
    assert df.select(C.dedup_attributes(F.col("a")).alias("d")).first().d == "a:1; b:2"
    typed = C.typed_cast(spark.createDataFrame([("12.7", "x", "2020-02-30")], "i string, n string, d string"), ["i"], ["n"], ["d"]).first()
    assert tuple(typed) == (12, None, None)


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text("1;Стол;Мебель;цвет:белый; цвет:белый\n2;Лампа;Свет;\n", encoding="utf-8")
    spark_path = f"file://{path}"
    rows = {r.item_id: r.attributes for r in S2.read_catalog(spark, spark_path).collect()}
    assert rows[2] == "" and rows[1].startswith("цвет")
    headed = tmp_path / "headed.csv"
    headed.write_text("STE_ID,Naimenovanie,Kategoriya\n7,Стул,Мебель\n", encoding="utf-8")
    row = S2.read_catalog(spark, f"file://{headed}", header=True).first()
    assert (row.item_id, row.name, row.category, row.attributes) == (7, "Стул", "Мебель", "")


def test_upsert(spark):
    old = spark.createDataFrame([(1, "A", "R", None, ["X"])], "user_id long, name string, region string, industry string, interests array<string>")
    new = spark.createDataFrame([(1, "", "S", "I", None), (2, "B", None, None, ["Y"]), (3, None, None, None, None)], old.schema)
    got = {r.user_id: tuple(r)[1:] for r in C.profile_upsert(old, new).collect()}
    assert got == {1: ("A", "S", "I", ["I"]), 2: ("B", None, "Y", ["Y"]), 3: (None, None, None, [])}


def test_preference_pairs_are_linear(spark):
    rows = [("g", i, i % 3, *[float(i)] * 11) for i in range(30)]
    df = spark.createDataFrame(rows, "group_id string, item_id long, relevance int, " + ", ".join(f"{f} double" for f in dicts.FEATURES))
    assert 0 < T.preference_pairs(df, 5).count() <= 150
