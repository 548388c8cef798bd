"""User profiles: shuffles of the mean vectors and of the category weights."""

from bidlens.operators import personal as P


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_components_of_vectors_are_not_shuffled(spark):
    """Vectors meet their user once; sums of components and their packing stay in that task."""
    items = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (2, 2, 1), (3, 9, 1)], "user_id long, item_id long, times long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id long, vector array<double>")
    out = P.profile_vectors(items, vectors.hint("broadcast"))
    assert "hashpartitioning(user_id" in out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id#" in out._jdf.queryExecution().executedPlan().toString() and exchanges(out) <= 1
    got = {r.user_id: [round(x, 4) for x in r.vector] for r in out.collect()}
    assert got == {1: [0.3162, 0.9487], 2: [0.0, 1.0]}


def test_category_weights_count_categories_once(spark):
    cats = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "a", 2)], "user_id long, category string, cnt long")
    out = P.category_weights(cats)
    assert exchanges(out) <= 1 and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "a", 0.75), (1, "b", 0.25), (2, "a", 1.0)]
