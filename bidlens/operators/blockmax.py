"""Block-max BM25: postings in blocks of neighbouring documents, of which a query reads only those that can matter.

A block holds one term's postings of one range of documents and the largest impact among them. The sum of a query's
largest impacts in a range bounds every score there, so ranges whose bound is below the query's k-th best score so far
are never scored. Ranges are the same for all terms, which makes the bound of a range a plain sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.functions.skew import salted_join
from bidlens.operators.analytics import numbered
from bidlens.session import cut_lineage

RANGE = 64  # documents of a range
PROBE = 8  # ranges of the highest bounds that give a query its first threshold
SLACK = 1e-5  # sums of floats and rounded scores differ by less


def range_of(index: DataFrame, key: str, size: int) -> Column:
    """Range of a document: neighbouring whole-number ids lie together, other keys are dealt by hash."""
    if isinstance(index.schema[key].dataType, T.IntegralType):
        return F.expr(f"CAST(floor(`{key}` / {size}) AS LONG)")
    return F.shiftright(F.xxhash64(key), 64 - 20)


def posting_blocks(index: DataFrame, key: str, size: int = RANGE) -> DataFrame:
    """(term, range, top, postings) from an index (term, key, tf, dl, impact); a block has at most ``size`` postings."""
    return index.withColumn("range", range_of(index, key, size)).groupBy("term", "range").agg(
        F.max("impact").alias("top"), F.sort_array(F.collect_list(F.struct(key, "tf", "dl", "impact"))).alias("postings")
    )


def postings_of(blocks: DataFrame) -> DataFrame:
    """The index that ``posting_blocks`` was made from."""
    return blocks.select("term", F.inline("postings"))


def write_blocks(blocks: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Keep blocks as a table bucketed by (term, range), so that joins on them need no shuffle of the postings.

    Hot terms are spread over buckets by range. Blocks are dealt to their bucket first, so each bucket is one file.
    """
    (
        blocks.repartition(buckets, "term", "range").write.mode("overwrite").format("parquet")
        .bucketBy(buckets, "term", "range").sortBy("term", "range").option("path", path).saveAsTable(table)
    )
    return blocks.sparkSession.table(table)


def open_blocks(spark: SparkSession, schema: T.StructType, table: str, path: str, buckets: int) -> DataFrame:
    """The table of an earlier ``write_blocks`` in a session whose catalogue does not know it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (term, range) SORTED BY (term, range) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def range_bounds(terms: DataFrame, blocks: DataFrame, query: str) -> DataFrame:
    """(query, range, bound): the sum of the largest impacts of the query's terms in each range that has any."""
    tops = salted_join(blocks.select("term", "range", "top"), terms, ["term"], ["range"])
    return tops.groupBy(query, "range").agg(F.sum("top").alias("bound"))


def scored_ranges(terms: DataFrame, blocks: DataFrame, wanted: DataFrame, key: str, query: str) -> DataFrame:
    """Scores of all documents in the wanted (query, range) pairs; only their blocks are opened."""
    opened = wanted.select(query, "range").join(terms, query).join(blocks.select("term", "range", "postings"), ["term", "range"])
    return opened.select(query, F.inline("postings")).groupBy(query, key).agg(F.round(F.sum("impact"), 6).alias("score"))


def two_passes(terms: DataFrame, blocks: DataFrame, sizes: DataFrame, key: str, query: str = "query", probe: int = PROBE):
    """(first, second): scores and the (query, range) pairs that each pass reads.

    ``sizes(query, k)``: how many documents a query wants. The first pass reads the ``probe`` ranges of the highest bounds;
    its k-th score is a threshold below which no document can come in. The second reads the ranges that may reach it.
    """
    terms = terms.select(query, "term").distinct()
    bounds = cut_lineage(range_bounds(terms, blocks, query), "bounds")
    placed = bounds.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(F.desc("bound"), "range")))
    tried = cut_lineage(placed.where(F.col("place") <= probe), "tried")
    first = cut_lineage(scored_ranges(terms, blocks, tried, key, query), "first-scores")
    kth = numbered(first.join(sizes, query), query, [F.desc("score")]).where("rn = k").select(query, F.col("score").alias("threshold"))
    left = bounds.join(tried.select(query, "range"), [query, "range"], "left_anti").join(kth, query, "left").where(
        F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - SLACK))
    left = cut_lineage(left.select(query, "range"), "left")
    return (first, tried), (scored_ranges(terms, blocks, left, key, query), left)


def block_max_score(terms: DataFrame, blocks: DataFrame, sizes: DataFrame, key: str, query: str = "query", probe: int = PROBE) -> DataFrame:
    """Best documents per query, ties at its k-th score included: (query, key, score, rk); the same rows as scoring all."""
    (first, _), (second, _) = two_passes(terms, blocks, sizes, key, query, probe)
    ranked = first.unionByName(second).withColumn("rk", F.rank().over(W.partitionBy(query).orderBy(F.desc("score"))))
    return ranked.join(sizes, query).where("rk <= k").drop("k")
