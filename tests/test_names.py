"""Names are scored once and handed to their items: the same rows as scoring every item, from few rows."""

from pyspark.sql import functions as F

from bidlens.functions import text as X
from bidlens.operators import retrieval as R
from bidlens.operators.analytics import top_per_group


def catalog(spark):
    """600 items of four names, one of them null, and an item with a name of its own."""
    names = ["small new bolt", "new lamp", "bolt bolt", None]
    rows = [(i, names[i % 4] if i else "odd new thing") for i in range(600)]
    return spark.createDataFrame(rows, "item_id long, name string").repartition(3)


def asked(spark):
    queries = spark.createDataFrame([("new bolt",), ("lamp",), ("bolt",), ("nowhere",)], "query string")
    return R.query_terms(queries)


def by_item(spark):
    docs = catalog(spark).select("item_id", X.words(F.col("name")).alias("tokens"))
    postings = R.term_postings(docs, "item_id", "tokens")
    return postings, R.bm25_index(postings, R.corpus_stats(docs, postings), "item_id")


def by_name(spark):
    names = R.distinct_names(catalog(spark)).withColumn("tokens", X.words(F.col("name")))
    postings = R.term_postings(names, "name", "tokens").join(names.select("name", "times"), "name")
    return postings, R.bm25_index(postings, R.corpus_stats(names, postings, F.col("times")), "name")


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scored_names_give_the_rows_of_scored_items(spark):
    terms, (item_postings, item_index), (name_postings, name_index) = asked(spark), by_item(spark), by_name(spark)
    assert name_postings.count() == 9  # not one row for every word of every item
    columns = ["query", "item_id", "matched", "ts_score"]
    names = R.lexical_any_rank(terms, name_postings, key="name")
    assert names.count() == 7 and found(R.to_items(names, catalog(spark)), *columns) == found(R.lexical_any_rank(terms, item_postings), *columns)
    columns = ["query", "item_id", "score"]
    scores = R.bm25_full_scores(terms, name_index, "name")
    assert found(R.to_items(scores, catalog(spark)), *columns) == found(R.bm25_full_scores(terms, item_index, "item_id"), *columns)


def test_best_items_of_names_are_those_of_all_items(spark):
    terms, item_index, name_index = asked(spark), by_item(spark)[1], by_name(spark)[1]
    columns = ["query", "item_id", "score", "rn"]
    for k in (1, 7, 200, 1000):
        want = top_per_group(R.bm25_scores(terms, item_index, "item_id"), "query", [F.desc("score"), "item_id"], k)
        got = R.best_items(R.bm25_scores(terms, name_index, "name"), catalog(spark), k)
        assert found(got, *columns) == found(want, *columns)
    assert R.best_items(R.bm25_scores(terms, name_index, "name"), catalog(spark).limit(0), 3).collect() == []
