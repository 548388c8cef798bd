"""Ranking quality over judged result lists: (run, query_id, rank, rel) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["run", "query_id"]
DEPTHS = (5, 10, 20)


def _linear(rel: Column) -> Column:
    return rel.cast("double")


def _exponential(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def _with_ideal(judged: DataFrame) -> DataFrame:
    """Adds the rank of the ideal order; a list is one result page pool, so it is bounded."""
    w = W.partitionBy(*KEYS).orderBy(F.desc("rel"), "rank")
    return judged.withColumn("ideal_rank", F.row_number().over(w))


def _dcg(gain: Column, rank: str, k: int) -> Column:
    return F.sum(F.when(F.col(rank) <= k, gain / F.log2(F.col(rank) + 1)).otherwise(0.0))


def _ndcg(gain: Column, k: int) -> Column:
    ideal = _dcg(gain, "ideal_rank", k)
    return F.round(F.when(ideal > 0, _dcg(gain, "rank", k) / ideal).otherwise(0.0), 6)


def dcg_ndcg_linear(judged: DataFrame) -> DataFrame:
    gain = _linear(F.col("rel"))
    return _with_ideal(judged).groupBy(*KEYS).agg(
        F.round(_dcg(gain, "rank", 10), 6).alias("dcg_10"), *[_ndcg(gain, k).alias(f"ndcg_{k}") for k in DEPTHS]
    )


def ndcg_exp(judged: DataFrame, k: int = 10, min_size: int = 2) -> DataFrame:
    """Exponential-gain NDCG of lists with at least ``min_size`` results."""
    return _with_ideal(judged).groupBy(*KEYS).agg(
        F.count("*").alias("n"), _ndcg(_exponential(F.col("rel")), k).alias("ndcg")
    ).where(F.col("n") >= min_size).drop("n")


def reciprocal_rank(judged: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("rel") > 0, F.col("rank")))
    return judged.groupBy(*KEYS).agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))


def average_precision(judged: DataFrame) -> DataFrame:
    """Mean precision at the relevant results that were retrieved."""
    w = W.partitionBy(*KEYS).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    hits = F.sum((F.col("rel") > 0).cast("int")).over(w)
    at = judged.withColumn("p", F.when(F.col("rel") > 0, hits / F.col("rank")))
    return at.groupBy(*KEYS).agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("ap"))


def precision_at_k(judged: DataFrame) -> DataFrame:
    return judged.groupBy(*KEYS).agg(
        *[(F.count_if((F.col("rank") <= k) & (F.col("rel") > 0)) / k).alias(f"p_{k}") for k in DEPTHS]
    )


def mean_over_queries(scores: DataFrame, column: str, out: str) -> DataFrame:
    return scores.groupBy("run").agg(F.round(F.avg(column), 6).alias(out))


def personalization_lift(ndcg: DataFrame, column: str, personalised: str, baseline: str) -> DataFrame:
    """Relative NDCG gain of one run over another, zero if the base is zero."""
    return ndcg.agg(
        F.avg(F.when(F.col("run") == personalised, F.col(column))).alias("p"),
        F.avg(F.when(F.col("run") == baseline, F.col(column))).alias("b"),
    ).select(
        F.round("p", 6).alias("ndcg_personalised"), F.round("b", 6).alias("ndcg_baseline"),
        F.round(F.when(F.col("b") != 0, (F.col("p") - F.col("b")) / F.col("b")).otherwise(0.0), 6).alias("lift"),
    )


def evaluate_search(judged: DataFrame) -> DataFrame:
    """All metrics of a run in one pass over its lists, as (run, metric, value) rows."""
    order = W.partitionBy(*KEYS).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    hits = F.sum((F.col("rel") > 0).cast("int")).over(order)
    rows = _with_ideal(judged).withColumn("p", F.when(F.col("rel") > 0, hits / F.col("rank")))
    gain = _linear(F.col("rel"))
    first = F.min(F.when(F.col("rel") > 0, F.col("rank")))
    per_query = rows.groupBy(*KEYS).agg(
        *[_ndcg(gain, k).alias(f"NDCG@{k}") for k in DEPTHS],
        *[(F.count_if((F.col("rank") <= k) & (F.col("rel") > 0)) / k).alias(f"P@{k}") for k in DEPTHS],
        F.coalesce(1.0 / first, F.lit(0.0)).alias("MRR"), F.coalesce(F.avg("p"), F.lit(0.0)).alias("MAP"),
    )
    names = [f"NDCG@{k}" for k in DEPTHS] + [f"P@{k}" for k in DEPTHS] + ["MRR", "MAP"]
    means = per_query.groupBy("run").agg(*[F.round(F.avg(f"`{n}`"), 5).alias(n) for n in names])
    return means.unpivot("run", [F.col(f"`{n}`") for n in names], "metric", "value")


def split_by_session(events: DataFrame, share: int = 8) -> DataFrame:
    """Adds ``variant``: sessions are dealt to the two runs of an experiment by hash; ``share`` sixteenths are personalised."""
    return events.withColumn(
        "variant", F.when(F.conv(F.substring(F.md5("session_id"), 1, 1), 16, 10).cast("int") < share, "personalised").otherwise("baseline"))


def ctr_bounce_delta(events: DataFrame) -> DataFrame:
    """Click and bounce rates of two variants and their difference; needs ``variant``. A variant without events has null rates."""
    share = lambda kind, v: F.try_divide(
        F.count_if((F.col("event_type") == kind) & (F.col("variant") == v)).cast("double"), F.count_if(F.col("variant") == v))
    rows = events.where("event_type in ('click', 'view', 'bounce')")
    return rows.agg(*[
        F.round(share(kind, v), 6).alias(f"{kind}_{v}") for kind in ("click", "bounce") for v in ("personalised", "baseline")
    ]).select(
        "*", F.round(F.col("click_personalised") - F.col("click_baseline"), 6).alias("ctr_delta"),
        F.round(F.col("bounce_personalised") - F.col("bounce_baseline"), 6).alias("bounce_delta"),
    )


# ---- lists as arrays -----------------------------------------------------------------------
# The same measures of a list that lies in one row, its grades ``rels`` in ranked order: nothing is sorted or shuffled per result.
def _list_dcg(rels: Column, gain, k: int) -> Column:
    terms = F.transform(F.slice(rels, 1, k), lambda r, i: gain(r) / F.log2(i + 2))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _list_ndcg(rels: Column, gain, k: int) -> Column:
    ideal = _list_dcg(F.sort_array(rels, asc=False), gain, k)
    return F.round(F.when(ideal > 0, _list_dcg(rels, gain, k) / ideal).otherwise(0.0), 6)


def _list_precision(rels: Column, k: int) -> Column:
    return F.size(F.filter(F.slice(rels, 1, k), lambda r: r > 0)) / k


def _list_rr(rels: Column) -> Column:
    first = F.array_position(F.transform(rels, lambda r: r > 0), True)
    return F.when(first > 0, 1.0 / first).otherwise(0.0)


def _list_ap(rels: Column) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"))
    step = lambda a, r: F.struct(
        F.when(r > 0, a["n"] + 1).otherwise(a["n"]).alias("n"),
        F.when(r > 0, a["s"] + (a["n"] + 1) / (a["i"] + 1)).otherwise(a["s"]).alias("s"), (a["i"] + 1).alias("i"))
    return F.aggregate(rels, start, step, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(0.0))


def lists_ndcg(lists: DataFrame) -> DataFrame:
    rels = F.col("rels")
    return lists.select(*KEYS, F.round(_list_dcg(rels, _linear, 10), 6).alias("dcg_10"), *[_list_ndcg(rels, _linear, k).alias(f"ndcg_{k}") for k in DEPTHS])


def lists_ndcg_exp(lists: DataFrame, k: int = 10, min_size: int = 2) -> DataFrame:
    return lists.where(F.size("rels") >= min_size).select(*KEYS, _list_ndcg(F.col("rels"), _exponential, k).alias("ndcg"))


def lists_rr(lists: DataFrame) -> DataFrame:
    return lists.select(*KEYS, _list_rr(F.col("rels")).alias("rr"))


def lists_ap(lists: DataFrame) -> DataFrame:
    return lists.select(*KEYS, _list_ap(F.col("rels")).alias("ap"))


def lists_precision(lists: DataFrame) -> DataFrame:
    return lists.select(*KEYS, *[_list_precision(F.col("rels"), k).alias(f"p_{k}") for k in DEPTHS])


def evaluate_lists(lists: DataFrame) -> DataFrame:
    """All metrics of a run, as (run, metric, value) rows."""
    rels = F.col("rels")
    measures = {f"NDCG@{k}": _list_ndcg(rels, _linear, k) for k in DEPTHS} | {f"P@{k}": _list_precision(rels, k) for k in DEPTHS}
    measures |= {"MRR": _list_rr(rels), "MAP": _list_ap(rels)}
    means = lists.groupBy("run").agg(*[F.round(F.avg(c), 5).alias(n) for n, c in measures.items()])
    return means.unpivot("run", [F.col(f"`{n}`") for n in measures], "metric", "value")
