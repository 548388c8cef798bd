"""BM25 of long queries (passages): hardly a range of documents can be skipped, so all are scored, but no match is shuffled.

Only postings of asked words are kept. Documents lie in parts of bounded size; a part meets the queries in blocks, and brings
back the best documents of it. Scores are products of a documents x words and a words x queries matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.operators.retrieval import B, K1
from bidlens.session import cut_lineage

PART = 4096  # documents of a part
QUERIES = 256  # queries of a block, about
CELLS = 1 << 21  # numbers of a matrix that a task holds at once
SLACK = 2e-6  # scores are rounded to six digits after the choice


def asked_postings(docs: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(document, term, tf, dl) of the words that are asked for. ``terms``: term."""
    words = docs.select(key, F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return words.join(terms, "term").groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def weights(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``weight``: the factor of an impact that lies with the document."""
    totals = docs.select(F.sum(F.when(F.col("tokens").isNotNull(), F.size("tokens")).otherwise(0)).alias("l"), F.count("*").alias("n"))
    average = totals.select(F.greatest(F.col("l") / F.col("n"), F.lit(1e-9))).scalar()
    return postings.withColumn("weight", F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average)))


def best_of_part(k: int):
    """Documents of a part that are among its ``k`` best of a query, ties at the last place included."""

    def call(block: pa.Table, docs: pa.Table) -> pa.Table:
        out = [[], [], []]
        if block.num_rows and docs.num_rows:
            words, column = np.unique(block.column("term").to_numpy(), return_inverse=True)
            queries, row = np.unique(block.column("query").to_numpy(), return_inverse=True)
            asked = np.zeros((len(words), len(queries)))
            asked[column, row] = block.column("idf").to_numpy()
            lists = docs.column("terms").combine_chunks()
            term, weight = lists.flatten().to_numpy(), docs.column("weights").combine_chunks().flatten().to_numpy()
            of = np.repeat(np.arange(docs.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(words, term), len(words) - 1)
            mine = words[at] == term
            at, of, weight = at[mine], of[mine], weight[mine]
            scores, step = np.zeros((docs.num_rows, len(queries))), max(1, CELLS // len(words))
            for lo in range(0, docs.num_rows, step):
                here = slice(*np.searchsorted(of, [lo, lo + step]))
                held = np.zeros((min(step, docs.num_rows - lo), len(words)))
                held[of[here] - lo, at[here]] = weight[here]
                scores[lo: lo + step] = held @ asked
            cut = max(0, docs.num_rows - k)
            least = np.partition(scores, cut, axis=0)[cut] - SLACK
            doc, query = np.nonzero((scores >= least) & (scores > 0))
            out = [queries[query], docs.column("doc").combine_chunks().take(pa.array(doc)), scores[doc, query]]
        return pa.table({"query": pa.array(out[0], pa.int64()), "doc": pa.array(out[1], docs.schema.field("doc").type), "score": pa.array(out[2], pa.float64())})

    return call


def passage_score(query_terms: DataFrame, docs: DataFrame, key: str, k: int, query: str = "query", part: int = PART, per_block: int = QUERIES) -> DataFrame:
    """Best ``k`` documents per query, ties at the threshold included: (query, key, score, rk); as scoring all postings.

    ``docs``: key, tokens; ``query_terms``: query, term. A query and a word go by their 64-bit hashes.
    """
    asked = cut_lineage(query_terms.select(query, "term").where(F.col(query).isNotNull()).distinct(), "asked")
    postings = cut_lineage(weights(asked_postings(docs, asked.select("term").distinct(), key), docs).groupBy(key).agg(
        F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("weight").alias("w"))).alias("hits")), "asked-postings")  # one entry a distinct word
    df = postings.select(F.explode("hits.t").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    n = docs.count()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    parts = max(1, -(-n // part))
    blocks = max(1, -(-asked.select(query).distinct().count() // per_block))
    sides = asked.select(F.xxhash64(query).alias("query"), F.xxhash64("term").alias("t")).join(df, "t").select(
        "query", F.col("t").alias("term"), idf.alias("idf"), F.pmod("query", F.lit(blocks)).cast("int").alias("block"))
    sides = sides.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kept = postings.select(
        F.col(key).alias("doc"), F.col("hits.t").alias("terms"), F.col("hits.w").alias("weights"),
        F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    kind = docs.schema[key].dataType.simpleString()
    found = sides.groupBy("part", "block").cogroup(kept.groupBy("part", "block")).applyInArrow(
        best_of_part(k), f"query long, doc {kind}, score double")
    names = asked.select(F.xxhash64(query).alias("query"), F.col(query).alias("name")).distinct()
    ranked = found.withColumn("score", F.round("score", 6)).withColumn("rk", F.rank().over(W.partitionBy("query").orderBy(F.desc("score"))))
    return ranked.where(F.col("rk") <= k).join(names, "query").select(F.col("name").alias(query), F.col("doc").alias(key), "score", "rk")
