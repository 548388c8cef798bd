"""Kept posting blocks and metric cells: the same rows as plain scoring, from fewer blocks and cells."""

import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from bidlens.operators import blockmax as B
from bidlens.operators import metrics as M
from bidlens.operators import retrieval as R
from bidlens.operators import suggesting
from bidlens.operators import vectorcells as C
from bidlens.operators import wordlists as L
from bidlens.session import kept, work_path


def texts(spark):
    """400 documents in topics of 40 neighbouring ids, with words that all share."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        own = [f"t{i // 40}w{k}" for k in range(30)]
        rows.append((i, [rng.choice(own) for _ in range(rng.randint(5, 30))] + [rng.choice(["common", "usual", "often"]) for _ in range(8)]))
    return spark.createDataFrame(rows, "doc long, tokens array<string>").repartition(3)


def test_blocks_give_the_rows_of_full_scoring(spark):
    docs = texts(spark)
    postings = R.term_postings(docs, "doc", "tokens")
    index = R.bm25_index(postings, R.corpus_stats(docs, postings), "doc").cache()
    path, table = work_path(spark, "blocks"), f"blocks_{uuid.uuid4().hex}"
    blocks = B.write_blocks(B.posting_blocks(index, "doc", 10), table, path, 4)
    assert blocks.count() == B.open_blocks(spark, blocks.schema, table + "_again", path, 4).count()
    assert sorted(map(tuple, B.postings_of(blocks).select(*index.columns).collect())) == sorted(map(tuple, index.collect()))
    asked = spark.createDataFrame(
        [("a", "t3w1"), ("a", "t3w5"), ("a", "common"), ("b", "t7w2"), ("b", "nowhere"), ("c", "usual"), ("d", "nowhere"), ("a", "common")],
        "query string, term string")
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 7), ("d", 5)], "query string, k int")
    want = R.bm25_scores(asked, index, "doc").withColumn("rk", F.expr("rank() over (partition by query order by score desc)")).join(
        sizes, "query").where("rk <= k").select("query", "doc", "score", "rk")
    got = B.block_max_score(asked, blocks, sizes, "doc", probe=2).select("query", "doc", "score", "rk")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() >= 15
    (_, first), (_, second) = B.two_passes(asked, blocks, sizes, "doc", probe=2)
    pairs = B.range_bounds(asked.distinct(), blocks, "query")
    read = {r.query: r["count"] for r in first.select("query", "range").union(second).groupBy("query").count().collect()}
    every = {r.query: r["count"] for r in pairs.groupBy("query").count().collect()}
    assert read["a"] <= every["a"] / 4 and set(read) == set(every)  # a topic's ranges, not the 40 that have its common word


def test_blocks_of_keys_that_are_no_numbers(spark):
    rows = [("x", "a", 1, 2, 1.5), ("y", "a", 1, 2, 0.5), ("y", "b", 2, 2, 1.0)]
    index = spark.createDataFrame(rows, "doc string, term string, tf int, dl int, impact double").select("term", "doc", "tf", "dl", "impact")
    asked = spark.createDataFrame([("q", "a"), ("q", "b")], "query string, term string")
    sizes = spark.createDataFrame([("q", 1)], "query string, k int")
    got = B.block_max_score(asked, B.posting_blocks(index, "doc"), sizes, "doc").collect()
    assert sorted((r.doc, r.score) for r in got) == [("x", 1.5), ("y", 1.5)]  # both, as they tie
    assert B.block_max_score(asked, B.posting_blocks(index.limit(0), "doc"), sizes, "doc").collect() == []


def test_kept_tables_are_built_once_and_anew_when_files_change(spark):
    path, built = work_path(spark, "source"), []
    spark.range(3).write.parquet(path)
    build = lambda: built.append(1) or len(built)
    assert [kept(spark, "t", path, build), kept(spark, "t", path, build)] == [1, 1]
    spark.range(5).write.mode("append").parquet(path)
    assert kept(spark, "t", path, build) == 2


def test_cells_give_exact_neighbours_and_skip_most_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8))
    vectors = np.concatenate([centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 8)) * 0.05, np.repeat(centres[:1], 60, axis=0)])
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "item_id long, vector array<double>").repartition(4)
    asked = [(f"q{i}", [float(x) for x in vectors[i * 17]], 3 + i % 20) for i in range(80)]
    queries = spark.createDataFrame([*asked, ("none", None, 3), ("all", asked[0][1], 5000)], "query string, vector array<double>, k int")
    cells = C.build_cells(items, per_cell=40)
    got = {}
    for r in C.cell_topk(queries, cells).orderBy("rn").collect():
        got.setdefault(r.query, []).append((r.item_id, r.score))
    for name, v, k in [*asked, ("all", asked[0][1], 5000)]:
        scores = np.floor(vectors @ np.array(v) * 1e6 + 0.5) / 1e6
        order = np.lexsort((np.arange(len(scores)), -scores))[:k]
        assert got.pop(name) == [(int(i), float(scores[i])) for i in order]
    assert got == {}
    some = spark.createDataFrame(asked, "id string, vector array<double>, k int").withColumn("threshold", F.lit(float("-inf")))
    first = C.reads(some, cells, False).select(F.sum(F.size("ids"))).first()[0]
    assert first < 0.3 * len(asked) * len(cells.geometry.counts)
    assert C.vector_topk(queries.select("query", "vector"), items.limit(0), 3).collect() == []


def test_queries_travel_once_to_a_bundle_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = np.concatenate([rng.normal(size=(600, 16)), np.repeat(rng.normal(size=(1, 16)), 150, axis=0)])  # unrelated, and one vector often
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(3)
    queries = items.select(F.col("item_id").alias("id"), "vector", F.lit(4).alias("k"), F.lit(-99.0).alias("threshold"))
    cells = C.build_cells(items, per_cell=10)
    assert len(cells.geometry.counts) > 50 and cells.blocks.count() <= 2
    first, second = (C.reads(queries, cells, again).select(F.sum(F.size("ids"))).first()[0] for again in (False, True))
    assert first + second <= 2 * len(rows) * cells.blocks.count()  # in cells: one row for each of over 50
    scores = np.floor(vectors @ vectors.T * 1e6 + 0.5) / 1e6
    want = {(i, n + 1): int(j) for i in range(len(rows)) for n, j in enumerate(np.lexsort((np.arange(len(rows)), -scores[i]))[:4])}
    for size in (C.BUNDLE, 64):  # one bundle, and parts of cells with several turns
        monkeypatch.setattr(C, "BUNDLE", size)
        found = C.cell_topk(queries.select(F.col("id").alias("query"), "vector", "k"), C.build_cells(items, per_cell=10)).collect()
        assert {(r.query, r.rn): r.item_id for r in found} == want and len(found) == len(want)


def test_rates_of_a_variant_without_events(spark):
    events = spark.createDataFrame([("click", "personalised"), ("view", "personalised")], "event_type string, variant string")
    row = M.ctr_bounce_delta(events).first()
    assert (row.click_personalised, row.click_baseline, row.ctr_delta) == (0.5, None, None)


def names(spark):
    rng = random.Random(7)
    words = ["red", "Steel", "bolt", "pipe", "long", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))) for i in range(300)] + [(900, "Red, red bolt"), (901, ""), (902, None)]
    return rows, spark.createDataFrame(rows, "item_id long, name string").repartition(3)


def test_items_with_all_words_and_phrases_from_word_lists(spark):
    rows, df = names(spark)
    blocks = B.write_blocks(L.word_blocks(df, "name", 16), f"words_{uuid.uuid4().hex}", work_path(spark, "words"), 4)
    asked = ["red bolt", "bolt red", "long", "steel steel pipe", "red missing", "x x", "pipe long x"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    split = {i: (n or "").lower().replace(",", " ").split() for i, n in rows}
    found = L.phrases(queries, blocks)
    got = {(r.query, r.item_id): sorted(r.starts) for r in found.collect()}
    want = {}
    for q in asked:
        w = q.split()
        for i, ws in split.items():
            at = [k for k in range(len(ws) - len(w) + 1) if ws[k: k + len(w)] == w]
            if at:
                want[q, i] = at
    assert got == want and len(want) > 60
    terms = R.query_terms(queries)
    hits = {(r.query, r.item_id): (r.n_terms, r.ts_score) for r in L.all_terms_score(terms, blocks).collect()}
    want = {}
    for q in asked:
        w = {t for t in q.split() if len(t) > 1}
        for i, ws in split.items():
            if w and w <= set(ws):
                want[q, i] = len(w), round(sum(1 - 1 / (1 + ws.count(t)) for t in w) / len(w), 6)
    assert {k: v[0] for k, v in hits.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(hits[k][1] - want[k][1]) < 2e-6 for k in want)
    plan = found._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    rare = L.rarest_first(terms.select("query", "term", F.lit(0).alias("slot")), blocks, "query").where("place = 1 and query = 'pipe long x'").first()
    df_of = {t: sum(t in ws for ws in split.values()) for t in ("pipe", "long")}
    assert rare.term == min(df_of, key=lambda t: (df_of[t], t))
    assert L.all_words(terms.select("query", "term", F.lit(0).alias("slot")), blocks.limit(0)).collect() == []


def test_suggestions_from_suffix_intervals(spark, monkeypatch):
    rows, df = names(spark)
    monkeypatch.setattr(suggesting, "PART", 40)  # frequent beginnings in many parts
    typed = ["re", "red", " RED b", "ed", "steel pipe", "x", "zz", "ol", "olt", "d r", "Red, red bolt", "", None, "t long p"]
    asked = spark.createDataFrame([(t,) for t in typed], "text string")
    got = {}
    for r in suggesting.suggest(asked, df, 4).orderBy("rn").collect():
        got.setdefault(r.text, []).append(r.name)
    every = sorted({n for _, n in rows if n})
    want = {t.strip(): [n for n in every if t.strip().lower() in n.lower()][:4] for t in typed if t and len(t.strip()) > 1}
    assert got == {t: n for t, n in want.items() if n} and len(got) > 8
    assert suggesting.suggest(asked.limit(0), df).collect() == [] == suggesting.suggest(asked, df.limit(0)).collect()
