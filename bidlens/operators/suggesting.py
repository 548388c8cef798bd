"""Suggestions from a sorted list of name suffixes: a typed text is an interval of it, nested intervals share one sweep."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.operators.analytics import top_per_group

LEAST = 2  # letters from which a text is looked up
PART = 200_000  # suffixes of a part of a two-letter beginning


def suffixes(names: DataFrame, longest: int) -> DataFrame:
    """(p, key, name): every suffix of two letters or more, as far as a typed text may reach, with its first two letters."""
    low = F.lower("name")
    starts = F.when(F.length(low) >= LEAST, F.sequence(F.lit(1), F.length(low) - (LEAST - 1)))
    keys = names.select("name", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(longest))))).alias("key"))
    return keys.select(F.left("key", F.lit(LEAST)).alias("p"), "key", "name")


def swept(k: int):
    """The first ``k`` names of each text in each part. Rows come in order of (p, part, key, kind), texts before suffixes.

    Open texts are a stack in which each one begins with the one below; a suffix that begins with the top belongs to all.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, list[str]]] = []  # key, text, first names so far
        group = None
        for batch in source:
            texts, names = [], []

            def close() -> None:
                _, text, best = stack.pop()
                texts.extend([text] * len(best))
                names.extend(best)

            for p, part, key, text, name in zip(*(batch.column(c).to_pylist() for c in ("p", "part", "key", "text", "name"))):
                while stack and (group != (p, part) or not key.startswith(stack[-1][0])):
                    close()
                group = p, part
                if name is None:
                    stack.append((key, text, []))
                    continue
                for _, _, best in stack:
                    if (len(best) < k or name < best[-1]) and name not in best:
                        insort(best, name)
                        del best[k:]
            yield _pairs(texts, names)
        texts, names = [], []
        for _, text, best in stack:
            texts += [text] * len(best)
            names += best
        yield _pairs(texts, names)

    return batches


def _pairs(texts: list[str], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(names, pa.string())], names=["text", "name"])


def suggest(asked: DataFrame, catalog: DataFrame, k: int = 8) -> DataFrame:
    """First ``k`` distinct names, alphabetically, that contain a typed text of two letters or more: (text, name, rn).

    Texts meet the suffixes of their first two letters only; frequent beginnings are dealt to parts by name, and a text's
    firsts of all parts are merged. No list of matches is made: each part hands on at most ``k`` names of a text.
    """
    typed = asked.select(F.trim("text").alias("text")).distinct().where(F.length("text") >= LEAST).select(
        "text", F.lower("text").alias("key"), F.left(F.lower("text"), F.lit(LEAST)).alias("p"))
    longest = typed.agg(F.max(F.length("key"))).first()[0]
    if longest is None:
        return typed.select("text", F.col("key").alias("name"), F.lit(0).alias("rn"))
    names = catalog.select("name").where("name is not null").distinct()
    listed = suffixes(names, longest).join(typed.select("p").distinct(), "p", "left_semi")
    parts = listed.groupBy("p").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    none = F.lit(None).cast("string")
    texts = typed.join(parts, "p").select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", "text", none.alias("name"))
    ends = listed.join(parts, "p").select("p", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), "key", none.alias("text"), "name")
    rows = texts.unionByName(ends).repartition("p", "part").sortWithinPartitions("p", "part", "key", F.col("name").isNotNull())
    return top_per_group(rows.mapInArrow(swept(k), "text string, name string"), "text", ["name"], k)
