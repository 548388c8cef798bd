"""Chat formatting: every participant's view of a dialogue (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.tables import stage

TURNS = 64  # turns rendered in one row; longer dialogues continue in further parts


def number_turns(turns: DataFrame) -> DataFrame:
    """Position of every turn in its dialogue, from 0, without gathering a dialogue in one task.

    The table is sorted once by range, so that a huge dialogue spans several tasks; a row's place within its task plus
    the dialogue's rows in earlier tasks gives its position. The sorted table is staged: positions are fixed.
    """
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"_head": F.substring("text", 1, 64), "_md5": F.md5("text"), "_row": F.monotonically_increasing_id()})
    ordered = clean.orderBy(
        F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), "speaker", "_head", "_md5", "_row"
    ).drop("_head", "_md5", "_row")
    fixed = stage(ordered.withColumn("_seq", F.monotonically_increasing_id()), "turns").withColumn(
        "_task", F.shiftright("_seq", 33)
    )
    pieces = fixed.groupBy("conv_id", "_task").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("conv_id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.select(
        F.col("conv_id").alias("_conv"), F.col("_task").alias("_t"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_task") == F.col("_t"))
    return fixed.join(base, same).select(
        "conv_id", "turn", "speaker", "text", (F.col("_seq") + F.col("_shift")).alias("pos")
    )


def rotate_perspectives(turns: DataFrame, most: int = TURNS) -> DataFrame:
    """One row per dialogue, participant and part: the dialogue as that participant's training text.

    Input: conv_id, turn, role, text. A role is a speaker's name; every speaker but ``system`` is a participant. In a
    participant's view its turns are the assistant's, others are users with their name, system turns stay. ``mask``
    lists start:end (code points of ``text``, end exclusive) of the assistant's words with their end mark, the parts to
    train on. A part holds up to ``most`` turns in order, so dialogues of any length stay bounded per row.

    Null role: speaker ``unknown``; null text: empty; null turn: last; null conv_id: one dialogue of its own. Equal turn
    numbers go by speaker, then text; repeated rows all stay. Dialogues with system turns only have no participant and
    give no rows, as do empty tables. Turn marks inside texts are broken by a space. Further columns are ignored.
    """
    numbered = number_turns(turns)
    people = numbered.where(F.col("speaker") != "system").select(
        F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")
    ).distinct()
    parts = numbered.groupBy("conv_id", F.floor(F.col("pos") / most).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "speaker", "text"))).alias("turns")
    )
    seen = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    def opening(t):
        name = F.when(t["speaker"] == "system", F.lit("system")).when(
            t["speaker"] == F.col("perspective"), F.lit("assistant")
        ).otherwise(F.concat(F.lit("user name="), F.regexp_replace(t["speaker"], "[\\s<>|]", "_")))
        return F.concat(F.lit("<|im_start|>"), name, F.lit("\n"))

    def body(t):
        return F.concat(F.replace(t["text"], F.lit("<|im_"), F.lit("< |im_")), F.lit("<|im_end|>"))

    shown = seen.withColumn("shown", F.transform("turns", lambda t: F.struct(
        opening(t).alias("opening"), body(t).alias("body"), (t["speaker"] == F.col("perspective")).alias("own"))))
    laid = shown.withColumn("ends", F.aggregate(
        "shown", F.array(F.lit(0)),
        lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(s["opening"]) + F.length(s["body"]) + 1)),
    ))
    spans = F.filter(
        F.transform("shown", lambda s, i: F.struct(
            s["own"].alias("own"), (F.get("ends", i) + F.length(s["opening"])).alias("start"),
            (F.get("ends", i + 1) - 1).alias("end"))),
        lambda s: s["own"],
    )
    return laid.select(
        "conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"),
        F.size(spans).cast("long").alias("n_trained"),
        F.array_join(F.transform("shown", lambda s: F.concat(s["opening"], s["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("mask"),
    )
