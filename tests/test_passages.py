"""Long queries: the same rows as scoring every posting, from postings of asked words in parts of bounded size."""

import random

from pyspark.sql import functions as F

from bidlens.operators import passages as G
from bidlens.operators import retrieval as R


def test_passages_score_as_all_postings_do(spark):
    rng = random.Random(7)
    rows = [(i, [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 30))] + [f"own{i}"]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(12)] + [(2000, []), (2001, None)]  # copies tie; a text without words counts
    docs = spark.createDataFrame(rows, "doc long, tokens array<string>").repartition(3)
    asked = [(f"q{n}", f"w{rng.randint(0, 40)}") for n in range(20) for _ in range(12)] + [("q0", "own5"), ("q1", "nowhere"), ("none", "nowhere")]
    terms = spark.createDataFrame([*asked, *asked[:5]], "query string, term string")
    postings = R.term_postings(docs, "doc", "tokens")
    want = R.bm25_score(terms, R.bm25_index(postings, R.corpus_stats(docs, postings), "doc"), "doc", 9)
    columns = ["query", "doc", "score", "rk"]
    want = sorted(map(tuple, want.select(*columns).collect()))
    for part, block in ((4096, 256), (50, 3)):
        got = G.passage_score(terms, docs, "doc", 9, part=part, per_block=block)
        assert sorted(map(tuple, got.select(*columns).collect())) == want and len(want) >= 180
    held = G.asked_postings(docs, terms.select("term").distinct(), "doc")
    assert held.where(F.col("term").startswith("own")).count() == 13  # words that nobody asks for are not carried
    assert G.passage_score(terms, docs.limit(0), "doc", 9).collect() == []
