"""What is known of a request, packed into its one row, so that its many candidates need no shuffle of their own.

Few of a request's candidates have a signal (a purchase, a click, a vote). Signals meet the hits of the queries on the item,
then the requests on user and query; what is left is listed per request as a map from item to values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions.skew import salted_join

KEYS = ("user_id", "session_id", "item_id")


def all_signals(tables: list[DataFrame]) -> DataFrame:
    """Signal tables (user_id, item_id, values, and session_id where they hold for one session only) below each other."""
    fields = {f.name: f.dataType for df in tables for f in df.schema.fields if f.name not in KEYS}
    kinds = {f.name: f.dataType for df in tables for f in df.schema.fields if f.name in KEYS} | fields
    rows = [
        df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in ("user_id", "item_id", *fields)],
                  (F.col("session_id") if "session_id" in df.columns else F.lit(None).cast("string")).alias("of_session"),
                  F.lit("session_id" in df.columns).alias("in_session"))
        for df in tables
    ]
    return reduce(DataFrame.unionByName, rows)


def met_signals(tables: list[DataFrame], requests: DataFrame, hits: DataFrame) -> DataFrame:
    """(request_id, item_id, values): the candidates that have a signal; null where another table has none."""
    signals = all_signals(tables)
    values = [c for c in signals.columns if c not in (*KEYS, "of_session", "in_session")]
    found = salted_join(signals.where("user_id is not null"), hits.select("query", "item_id").distinct(), ["item_id"], ["user_id"])
    met = found.join(requests.select("request_id", "user_id", "session_id", "query"), ["user_id", "query"]).where(
        "not in_session or of_session = session_id")
    return met.groupBy("request_id", "item_id").agg(*[F.max(c).alias(c) for c in values])


def noted(tables: list[DataFrame]) -> DataFrame:
    """(request_id, notes): map from item to its values, from tables of ``met_signals``."""
    values = [c for df in tables for c in df.columns if c not in ("request_id", "item_id")]
    met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    if len(tables) > 1:
        met = met.groupBy("request_id", "item_id").agg(*[F.max(c).alias(c) for c in values])
    return met.groupBy("request_id").agg(
        F.map_from_entries(F.collect_list(F.struct("item_id", F.struct(*values)))).alias("notes"))  # bounded by the page pool


def read_notes(cands: DataFrame, values: list[str]) -> DataFrame:
    """The values of each candidate's item as columns."""
    return cands.withColumn("_note", F.element_at("notes", F.col("item_id"))).withColumns(
        {c: F.col("_note")[c] for c in values}).drop("_note", "notes")


def packed(df: DataFrame, key: list[str], name: str, value: str | Column, out: str) -> DataFrame:
    """(key, out): map from ``name`` to ``value``; a name occurs once per key."""
    entry = F.struct(F.col(name), F.col(value) if isinstance(value, str) else value)
    return df.where(F.col(name).isNotNull()).groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias(out))


def best_of_request(met: DataFrame, count: str, top: int) -> DataFrame:
    """``met`` with ``co_purchase``: the share of the largest count, for the ``top`` items of a request by count."""
    order = W.partitionBy("request_id").orderBy(F.desc_nulls_last(count), "item_id")
    peak = F.max(count).over(W.partitionBy("request_id"))
    return met.withColumn("_rn", F.row_number().over(order)).withColumn(
        "co_purchase", F.when(F.col("_rn") <= top, F.round(F.lit(0.4) * F.col(count) / peak, 3))
    ).drop("_rn")
