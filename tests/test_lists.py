"""Measures of lists that lie in one row: those of the same lists as rows, without a sort or a shuffle of results."""

import random

from bidlens.operators import metrics as M


def test_lists_in_rows_give_the_measures_of_rows(spark):
    rng = random.Random(3)
    lists = [("a", f"q{n}", [rng.choice([0, 0, 0, 1, 2, 4]) for _ in range(rng.randint(1, 40))]) for n in range(60)]
    lists += [("b", "none", [0, 0, 0]), ("b", "one", [4])]
    packed = spark.createDataFrame(lists, "run string, query_id string, rels array<int>")
    rows = spark.createDataFrame([(r, q, i + 1, x) for r, q, xs in lists for i, x in enumerate(xs)], "run string, query_id string, rank int, rel int")
    pairs = [(M.lists_ndcg, M.dcg_ndcg_linear), (M.lists_ndcg_exp, M.ndcg_exp), (M.lists_rr, M.reciprocal_rank), (M.lists_ap, M.average_precision),
             (M.lists_precision, M.precision_at_k), (M.evaluate_lists, M.evaluate_search)]
    for of_lists, of_rows in pairs:
        got, want = of_lists(packed), of_rows(rows)
        kept = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*want.columns).collect())
        assert kept(got) == kept(want)
    plan = M.lists_ndcg(packed)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
