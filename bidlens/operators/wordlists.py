"""Word lists with positions: items that hold all words of a query, and phrases, from the shortest list outwards.

Lists are kept in blocks like the BM25 index (term, range of items), bucketed by both. A query opens the blocks of its
rarest word; every other word is only probed at the items found so far, so long lists are never dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import text as X
from bidlens.functions.skew import salted_join
from bidlens.operators.blockmax import RANGE, range_of


def positions(text: Column) -> Column:
    """All words of a normalised text in order."""
    return F.filter(F.split(X.normalize_text(text), " "), lambda w: F.length(w) > 0)


def word_blocks(items: DataFrame, text: str, size: int = RANGE) -> DataFrame:
    """(term, range, n, postings) of ``items(item_id, text)``; a posting has item, count and positions of the word."""
    placed = items.select("item_id", F.posexplode(positions(F.col(text))).alias("at", "term"))
    lists = placed.groupBy("term", "item_id").agg(F.sort_array(F.collect_list("at")).alias("at"))  # bounded by a text
    posting = F.struct("item_id", F.size("at").alias("tf"), "at")
    return lists.withColumn("range", range_of(lists, "item_id", size)).groupBy("term", "range").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(posting)).alias("postings"))


def rarest_first(words: DataFrame, blocks: DataFrame, query: str) -> DataFrame:
    """(query, slot, term, place, slots) of queries all of whose words occur; place 1 is the word with the shortest list."""
    lengths = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    asked = words.join(lengths, "term", "left")
    per_query = W.partitionBy(query)  # the words of one query
    return asked.withColumn("slots", F.count("*").over(per_query)).withColumn("known", F.count("df").over(per_query)).where("known = slots").withColumn(
        "place", F.row_number().over(per_query.orderBy("df", "term", "slot"))).select(query, "slot", "term", "place", "slots")


def opened(rare: DataFrame, blocks: DataFrame, query: str) -> DataFrame:
    """Postings of the rarest words: (query, slots, slot, range, item_id, tf, at)."""
    ranges = salted_join(blocks.select("term", "range"), rare, ["term"], ["range"])
    return ranges.join(blocks.select("term", "range", "postings"), ["term", "range"]).select(query, "slots", "slot", "range", F.inline("postings"))


def all_words(words: DataFrame, blocks: DataFrame, query: str = "query") -> DataFrame:
    """(query, item_id, hits) of the items that hold all words of a query; ``words``: query, slot, term, one row a word.

    ``hits`` has slot, tf and positions of each word. A query with a word that occurs nowhere has no rows.
    """
    ordered = rarest_first(words, blocks, query)
    found = opened(ordered.where("place = 1"), blocks, query)
    probes = found.select(query, "item_id", "range").join(ordered.where("place > 1").select(query, "slot", "term", "slots"), query)
    met = probes.join(blocks.select("term", "range", "postings"), ["term", "range"]).select(
        query, "slots", "slot", F.inline(F.filter("postings", lambda p: p["item_id"] == F.col("item_id"))))
    columns = [query, "slots", "slot", "item_id", "tf", "at"]
    both = found.select(*columns).unionByName(met.select(*columns))
    return both.groupBy(query, "item_id").agg(
        F.max("slots").alias("slots"), F.collect_list(F.struct("slot", "tf", "at")).alias("hits")  # one entry a word
    ).where(F.size("hits") == F.col("slots")).select(query, "item_id", F.array_sort("hits").alias("hits"))


def all_terms_score(terms: DataFrame, blocks: DataFrame, query: str = "query") -> DataFrame:
    """(query, item_id, n_terms, ts_score) of items with all terms; weight sum(1 - 1/(1+tf)) / n_terms. ``terms``: query, term."""
    words = terms.select(query, "term").distinct().withColumn("slot", F.lit(0))
    weight = F.aggregate("hits", F.lit(0.0), lambda s, h: s + (1 - 1 / (1 + h["tf"])))
    return all_words(words, blocks, query).select(
        query, "item_id", F.size("hits").cast("long").alias("n_terms"), F.round(weight / F.size("hits"), 6).alias("ts_score"))


def phrases(queries: DataFrame, blocks: DataFrame, query: str = "query") -> DataFrame:
    """(query, item_id, starts): items where the words of a query stand next to each other in order, and where."""
    words = queries.select(query).distinct().select(query, F.posexplode(positions(F.col(query))).alias("slot", "term"))
    starts = F.transform("hits", lambda h: F.transform(h["at"], lambda at: at - h["slot"]))
    common = F.aggregate(starts, F.element_at(starts, 1), F.array_intersect)
    return all_words(words, blocks, query).select(query, "item_id", common.alias("starts")).where(F.size("starts") > 0)
