"""Lambda trees, the neural ranker and Shapley values: better than the plain models, checked against brute force and DuckDB."""

from itertools import permutations

import duckdb
import numpy as np
import pytest

from bidlens.functions import dicts
from bidlens.operators import boosting as G
from bidlens.operators import metrics as M
from bidlens.operators import neural as N
from bidlens.operators import training as T


@pytest.fixture(scope="module")
def judged(spark):
    """Lists whose grades hang on an interaction of two features, which no linear score can follow."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(60):
        shift = rng.random()  # lists differ in level, as those of different queries do
        for i in range(25):
            x = rng.random(len(dicts.FEATURES))
            want = 3 * float((x[0] > 0.5) != (x[1] > 0.5)) + x[4] + 0.3 * rng.normal()
            x[5] = shift
            rows.append((f"g{g}", i, int(np.clip(round(want), 0, 4)), *map(float, x)))
    schema = "group_id string, item_id long, relevance int, " + ", ".join(f"{f} double" for f in dicts.FEATURES)
    df = spark.createDataFrame(rows, schema).repartition(3).cache()
    return df.where("cast(substring(group_id, 2) as int) < 45"), df.where("cast(substring(group_id, 2) as int) >= 45")


def ndcg(scored):
    runs = M.ndcg_exp(T.as_judged(scored, "r"))
    return M.mean_over_queries(runs, "ndcg", "v").first().v


@pytest.fixture(scope="module")
def trees(judged):
    return G.fit_lambda_trees(judged[0], trees=8, depth=3)


def test_lambda_trees_rank_better_than_the_linear_model(spark, judged, trees):
    train, valid = judged
    linear = T.pairwise_score(T.train_pairwise_ranker(train), valid)
    assert ndcg(valid.withColumn("model_score", G.trees_score(trees))) > ndcg(linear) + 0.05
    assert {n.cover for n in trees if n.node == 0} == {train.count()}
    assert abs(sum(v for _, v in G.importances(trees)) - 1) < 1e-9


def test_tree_table_scores_the_same_in_duckdb(spark, judged, trees):
    valid = judged[1].withColumn("model_score", G.trees_score(trees)).toPandas()
    nodes = G.node_table(spark, trees).toPandas()
    again = G.read_nodes(G.node_table(spark, trees))
    assert again == trees
    names = ", ".join(f"'{f}'" for f in dicts.FEATURES)
    values = ", ".join(f"CAST({f} AS DOUBLE)" for f in dicts.FEATURES)
    got = duckdb.sql(f"""
        WITH RECURSIVE w AS (SELECT group_id, item_id, tree, node FROM valid, (SELECT DISTINCT tree, 0 AS node FROM nodes)
          UNION ALL SELECT w.group_id, w.item_id, w.tree, CASE WHEN x <= threshold THEN n.left ELSE n.right END
          FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN
            (SELECT group_id, item_id, unnest([{values}]) AS x, generate_subscripts([{names}], 1) - 1 AS f FROM valid) v
            ON v.group_id = w.group_id AND v.item_id = w.item_id AND v.f = n.feature)
        SELECT w.group_id, w.item_id, sum(value) AS score FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE feature < 0 GROUP BY 1, 2
    """).df()
    both = got.merge(valid, on=["group_id", "item_id"])
    assert len(both) == len(valid) and np.abs(both["score"] - both["model_score"]).max() < 1e-9


def value_of(tree, x, known):
    """A tree's mean over branches that the known features do not decide."""
    by = {n.node: n for n in tree}

    def at(k):
        n = by[k]
        if n.feature < 0:
            return n.value
        if n.feature in known:
            return at(n.left if x[n.feature] <= n.threshold else n.right)
        return (at(n.left) * by[n.left].cover + at(n.right) * by[n.right].cover) / n.cover

    return at(0)


def test_shapley_values_equal_brute_force_and_add_up(spark, judged, trees):
    small = [n for n in trees if n.tree < 3]
    used = sorted({n.feature for n in small if n.feature >= 0})[:6]
    rows = judged[1].limit(6)
    x = np.array([[r[f] for f in dicts.FEATURES] for r in rows.collect()])
    small = [n for t in G.by_tree(small) if {n.feature for n in t} <= {*used, -1} for n in t]
    got = G.shapley(small, x)
    orders = list(permutations(used))
    for i, row in enumerate(x[:2]):
        for f in used:
            gain = 0.0
            for order in orders:
                before = set(order[: order.index(f)])
                gain += sum(value_of(t, row, before | {f}) - value_of(t, row, before) for t in G.by_tree(small))
            assert abs(got[i, f] - gain / len(orders)) < 1e-9
    table = G.with_shapley(trees, judged[1], ["group_id", "item_id"]).join(
        judged[1].withColumn("s", G.trees_score(trees)), ["group_id", "item_id"]).select("shap", "s").collect()
    base = G.mean_score(trees)
    assert all(abs(sum(r.shap) - (r.s - base)) < 1e-9 for r in table) and len(table) == judged[1].count()
    top = G.top_shapley(trees, judged[1], ["group_id", "item_id"]).where("group_id = 'g50' and item_id = 3").orderBy("place").collect()
    assert [r.place for r in top] == [1, 2, 3] and abs(top[0].value) >= abs(top[1].value) >= abs(top[2].value)


def test_net_beats_the_linear_model_on_validation_pairs(spark, judged):
    train, valid = judged
    weights = N.fit_net(train, rounds=60)
    assert [w.shape for w in weights] == [(11, 32), (32,), (32, 16), (16,), (16, 1), (1,)]
    scored = valid.withColumn("model_score", N.net_score(weights)).cache()
    linear = T.pairwise_score(T.train_pairwise_ranker(train), valid)
    assert N.preference_share(scored, "model_score") > N.preference_share(linear, "model_score") + 0.05
    x = np.array([[r[f] for f in dicts.FEATURES] for r in scored.collect()])
    again = N.read_weights(N.weight_table(spark, weights))
    assert np.abs(N.forward(again, x)[-1][:, 0] - np.array([r.model_score for r in scored.collect()])).max() < 1e-9


def test_gradients_equal_differences(spark, judged):
    weights = N.first_weights(1)
    rows = N.preferences(judged[0].limit(200)).toArrow().to_batches()
    sums = next(N.gradient_sums(weights)(rows)).column(0)[0].as_py()
    flat = np.concatenate([w.ravel() for w in weights])
    for k in (0, 40, 400, len(flat) - 5):
        moved = []
        for d in (1e-5, -1e-5):
            f = flat.copy()
            f[k] += d
            moved.append(next(N.gradient_sums(N.shaped(f))(rows)).column(0)[0].as_py()[-2])
        assert abs((moved[0] - moved[1]) / 2e-5 - sums[k]) < 1e-3 * max(1, abs(sums[k]))


def test_groups_without_preferences_are_harmless(spark, judged):
    flat = judged[0].limit(40).selectExpr("group_id", "item_id", "1 AS relevance", *dicts.FEATURES)
    model = G.fit_lambda_trees(flat, trees=2)
    assert all(n.value == 0 for n in model) and [w.shape for w in N.fit_net(flat, rounds=2)][0] == (11, 32)
