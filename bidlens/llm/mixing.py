"""Mixing sources to target weights by hash thresholds found in histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.tables import WORD, stage, unclashed, whole_text

WEIGHTS = (5, 2, 1)
REPEATS = 3
BITS = 12  # bits of the hash that one histogram resolves
LEVELS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """Target of each source: its weight's part of ``share`` of all sizes, at most ``repeats`` times its size.

    Input: one row per source (source, source_size), a table as small as the number of sources. Sources in code point
    order, null last, take ``weights`` in turn. What a full source leaves is shared anew by weight among the rest
    until none is above: filled in order of cap per weight, source i is full when the rest's level reaches its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * repeats)
        .withColumn("total", F.sum("source_size").over(everything).cast("double") * share)
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    # the first source that does not fill up sets the level for itself and all after it
    return ranked.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)["level"]).select(
        "source", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def digit(level: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def same(*pairs) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def thresholds(rows: DataFrame, budgets: DataFrame, nearest: bool, levels: int = LEVELS) -> DataFrame:
    """Hash threshold of each source so that rows below it hold its budget, and what then is left of the budget.

    ``rows``: source, hash, size; ``budgets``: source, budget (above 0). Sizes are summed by source and the leading
    hash bits; the bucket that crosses the budget is refined by the next bits, so each level reads only the boundary
    buckets' rows. Nothing is sorted but a histogram of at most 2**BITS buckets a source. The last boundary bucket (a
    2**-36 part of the source at three levels, mostly one row) stays out, or with ``nearest`` comes in if the sum then
    is nearer to the budget. Thresholds are nested: a smaller budget's rows are always among a larger one's. A source
    whose rows do not reach the budget gets all of them: it is known at the first level and carried through the others.
    """
    top = 1 << (BITS * levels)
    state = budgets.select(F.col("source").alias("_s"), F.col("budget").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(levels):
        inside = rows if level == 0 else rows.withColumn("_p", F.shiftrightunsigned("hash", 64 - BITS * level))
        on = same(("source", "_s")) if level == 0 else same(("source", "_s"), ("_p", "prefix"))
        histogram = inside.join(state, on).groupBy("_s", "rest", "prefix", digit(level).alias("bucket")).agg(
            F.sum("size").alias("sum")
        )
        running = Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = histogram.withColumn("upto", F.sum("sum").over(running))
        over = F.when(F.col("upto") >= F.col("rest"), F.struct("bucket", "upto", "sum"))
        first = summed.groupBy("_s", "rest", "prefix").agg(F.min(over).alias("b"), F.sum("sum").alias("all"))
        short = F.col("b").isNull()
        found = first.select(
            "_s",
            F.when(short, F.col("rest") - F.col("all")).otherwise(F.col("rest") - F.col("b.upto") + F.col("b.sum")).alias("rest"),
            F.when(short, F.lit(top)).otherwise(F.shiftleft("prefix", BITS) + F.col("b.bucket")).alias("prefix"),
            F.coalesce("b.sum", F.lit(0)).alias("bucket_sum"),
        )
        state = stage(found if level == 0 else found.unionByName(state.where(F.col("prefix") == top)), "threshold")
    into = F.lit(0) if not nearest else (F.col("rest") * 2 >= F.col("bucket_sum")).cast("long")
    return state.select(F.col("_s").alias("_c"), (F.least(F.col("prefix"), F.lit(top)) + into).alias("below"), "rest")


def text_hash() -> Column:
    """Places a document in its source's order; rows without id, or of one id, are told apart by their texts."""
    return F.xxhash64(F.lit("mix"), "doc_id", whole_text())


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row, see ``mixed``."""
    return mixed(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, share: float = 1.0, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, hash, size, source_size, target and taken (words the mix takes, repeats counted) of every row.

    size is the number of words (null or empty text: 0). A document is taken ``floor(target / source_size)`` times, and
    once more if its hash lies below its source's threshold. What is left up to the target (less than the document at
    the threshold) goes by a second threshold to documents above it that are no longer than that. No document exceeds
    ``repeats`` times its size. The hash depends on doc_id and text: reruns agree,
    repeated rows of a source share one fate, and rows without id do so only if their texts are equal. Null sources are
    one source. Sources without words have
    target 0. Empty tables give no rows; further columns are ignored. A hot source is never gathered: only histograms
    of partial sums move.
    """
    sized = stage(docs.select(
        "doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        text_hash().alias("hash"),
    ), "sizes")
    totals = stage(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats, share), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = totals.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    cut = thresholds(sized, plan.where(F.col("budget") > 0).select("source", "budget"), False, levels)
    bounds = plan.join(cut, same(("source", "_c")), "left").select(
        F.col("source").alias("_s"), "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below"),
        F.floor(F.coalesce("rest", F.lit(0))).alias("room"),
    )
    position = F.shiftrightunsigned("hash", 64 - BITS * levels)
    placed = sized.join(bounds, same(("source", "_s"))).withColumn("position", position)
    beyond = (F.col("position") >= F.col("below")) & (F.col("size") > 0) & (F.col("size") <= F.col("room"))
    fill = thresholds(
        placed.where(beyond).select("source", "hash", "size"),
        bounds.where(F.col("room") > 0).select(F.col("_s").alias("source"), F.col("room").cast("double").alias("budget")),
        True, levels,
    ).select("_c", F.col("below").alias("fill"))
    extra = (F.col("position") < F.col("below")) | (beyond & (F.col("position") < F.coalesce("fill", F.lit(0))))
    return placed.join(fill, same(("source", "_c")), "left").select(
        "doc_id", "source", "hash", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * (F.col("passes") + extra.cast("long"))).cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to ``repeats`` times); empty texts count as not taken."""
    times = mixed(docs, **options).groupBy("doc_id", "source", "hash").agg(
        F.max(F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)).alias("_times")
    ).toDF("_id", "_source", "_hash", "_times")
    plain, _ = unclashed(docs, {"doc_id", "text", "lang", "source", "n_chars"})
    on = same(("doc_id", "_id"), ("source", "_source"), ("_place", "_hash"))
    return plain.withColumn("_place", text_hash()).join(times, on).where(F.col("_times") > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))
    ).select(*plain.columns).toDF(*docs.columns)
