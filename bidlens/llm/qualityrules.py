"""Quality rules: hard rules plus an isolation forest on rule statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.llm.tables import stage
from bidlens.llm.textstats import COUNTS, RATIOS, text_stats

TREES = 200
TREE_ROWS = 256  # good rows of a tree, drawn from all labelled rows
DIGITS = (51, 38, 25, 12, 0)  # lowest bits of the digits of a double by which its rank is found
LOSS = 0.001  # share of good labelled rows that the threshold may reject
SEED = 17


def harmonic(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, dtype=float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator, deepest: int) -> dict:
    """Arrays of a tree of random splits: feature (-1: leaf), cut, children, path length at leaves."""
    feature, cut, left, right, path = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(feature)
        for part, value in ((feature, -1), (cut, 0.0), (left, at), (right, at), (path, depth + float(harmonic(len(rows))))):
            part.append(value)
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) < 2 or not len(open_):
            return at
        f = int(rng.choice(open_))
        c = float(rng.uniform(low[f], high[f]))
        below = rows[:, f] < c
        if below.all() or not below.any():
            return at
        feature[at], cut[at] = f, c
        left[at] = node(rows[below], depth + 1)
        right[at] = node(rows[~below], depth + 1)
        return at

    node(x, 0)
    return {k: np.array(v) for k, v in (("feature", feature), ("cut", cut), ("left", left), ("right", right), ("path", path))}


def excess(model: dict, x: np.ndarray) -> np.ndarray:
    """How far each statistic lies outside the range of good rows, in standard deviations of the labelled rows."""
    return (np.maximum(x - model["high"], 0) + np.maximum(model["low"] - x, 0)) / model["unit"]


def ranked_values(rows: DataFrame, wanted: list[tuple[str, int]]) -> list[float]:
    """The exact values at ranks (from 0) of columns of non-negative doubles, digit by digit of their bits.

    A pass counts the next digit of the values that agree in all earlier ones; the driver sees at most 8,192 counts a rank.
    """
    known, rank, high = [0] * len(wanted), [r for _, r in wanted], 64
    columns = list(dict.fromkeys(c for c, _ in wanted))
    for shift in DIGITS:
        def digits(batches, known=tuple(known), high=high, shift=shift):
            for batch in batches:
                for t, (c, _) in enumerate(wanted):
                    bits = np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)).view(np.uint64)
                    if high < 64:
                        bits = bits[bits >> np.uint64(high) == known[t]]
                    digit, n = np.unique(bits >> np.uint64(shift), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(digit), t, np.int32)), pa.array(digit.astype(np.int64)), pa.array(n.astype(np.int64))], names=["t", "digit", "n"])

        counts = rows.select(*columns).mapInArrow(digits, "t int, digit long, n long").groupBy("t", "digit").agg(F.sum("n").alias("n"))
        left = set(range(len(wanted)))
        for r in sorted(counts.collect(), key=lambda r: r.digit):
            if r.t in left and rank[r.t] < r.n:
                known[r.t] = r.digit
                left.remove(r.t)
            elif r.t in left:
                rank[r.t] -= r.n
        high = shift
    return [float(v) for v in np.array(known, np.uint64).view(float)]


def drawn(rows: DataFrame, n_good: int, n_bad: int, trees: int, sizes: tuple[int, int]) -> DataFrame:
    """Rows of every tree: of all good and of all bad rows ``sizes`` many by hash; a row is offered to as many trees as need it."""
    offers = [min(trees, -(-2 * trees * size // n)) for size, n in zip(sizes, (n_good, n_bad))]
    good = F.col("good") == 1
    number = F.sequence(F.lit(0), F.when(good, offers[0]).otherwise(offers[1]) - 1)
    offered = rows.withColumn("tree", F.explode(number)).withColumn(
        "tree", F.pmod(F.xxhash64("doc_id", F.lit(SEED)) + F.col("tree"), F.lit(trees)).cast("int"))
    order = W.partitionBy("tree", "good").orderBy(F.xxhash64("doc_id", "tree"), "doc_id", *RATIOS)
    limit = F.when(good, sizes[0]).otherwise(sizes[1])
    return offered.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= max(sizes)).where(F.col("_rn") <= limit).drop("_rn")


TREE = {"feature": "bigint", "cut": "double", "left": "bigint", "right": "bigint", "path": "double"}


def grown(model: dict, deepest: int):
    def call(key, table):
        x, good = matrix(table), table.column("good").to_numpy()
        order = np.lexsort((*x.T, good))
        tree = grow_tree(excess(model, x[order]), np.random.default_rng((SEED, key[0].as_py())), deepest)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([tree[c].tolist()], pa.list_(pa.int64() if kind == "bigint" else pa.float64()))
                                                                         for c, kind in TREE.items()}})

    return call


def matrix(table) -> np.ndarray:
    return np.stack([table.column(r).to_numpy() for r in RATIOS], axis=1)


def fit_forest(rows: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, loss: float = LOSS) -> dict:
    """Forest on labelled ``rows`` (doc_id, good, RATIOS), and the score above which at most ``loss`` of the good ones lie.

    A rule statistic is the excess over the range that all but ``loss`` of the good rows keep on each side. Splits are
    random, so the mean path length tells how soon a document is separated from the rest; the score is
    2 ** -(mean path / expected path). The threshold lies midway between the good rows' limit and the next bad row.
    Ranges, deviations and threshold are those of all rows; each tree draws its own rows from all of them, as isolation
    trees do, and grows in a task. Without good or without bad labelled rows nothing is rejected.
    """
    facts = rows.agg(F.count_if(F.col("good") == 1).alias("good"), F.count("*").alias("all"), *[F.stddev_pop(r).alias(r) for r in RATIOS]).first()
    n, n_bad = facts["good"], facts["all"] - facts["good"]
    if not n or not n_bad:
        return {"trees": [], "scale": 1.0, "threshold": np.inf, "low": 0.0, "high": 0.0, "unit": 1.0}
    normal, top = rows.where("good = 1"), int(np.ceil((1 - loss) * (n - 1)))
    ends = ranked_values(normal, [(r, int(loss * (n - 1))) for r in RATIOS] + [(r, top) for r in RATIOS])
    low, high = np.array(ends).reshape(2, -1)
    model = {"low": low, "high": high, "unit": np.array([max(round(facts[r], 12), 1e-9) for r in RATIOS]), "trees": [], "threshold": np.inf}
    sample = min(tree_rows, n)
    few = min(n_bad, max(1, sample // 16))  # each tree's ranges cover good and bad rows
    deepest = int(np.ceil(np.log2(max(sample, 2)))) + 4
    schema = "tree int, " + ", ".join(f"{c} array<{kind}>" for c, kind in TREE.items())
    forest = drawn(rows, n, n_bad, trees, (sample, few)).groupBy("tree").applyInArrow(grown(model, deepest), schema)
    model["trees"] = [{c: np.array(r[c]) for c in TREE} for r in sorted(forest.collect(), key=lambda r: r.tree)]  # TREES rows
    model["scale"] = max(float(harmonic(sample)), 1e-9)
    scores = stage(scored(rows, model), "rule-scores")
    limit = ranked_values(scores.where("good = 1"), [("score", top)])[0]
    above = scores.where((F.col("good") != 1) & (F.col("score") > limit)).agg(F.min("score")).first()[0]
    model["threshold"] = limit if above is None else (limit + above) / 2
    return model


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """(good, score) of labelled rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scores(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(forest_scores(shared.value, matrix(batch)))], names=["good", "score"])

    return rows.select("good", *RATIOS).mapInArrow(scores, "good long, score double")


def forest_scores(model: dict, x: np.ndarray) -> np.ndarray:
    x = excess(model, x)
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in model["trees"]:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = t["feature"][at]
            inner = f >= 0
            if not inner.any():
                break
            go = x[rows, np.maximum(f, 0)] < t["cut"][at]
            at = np.where(inner, np.where(go, t["left"][at], t["right"][at]), at)
        total += t["path"][at]
    return 2.0 ** (-total / (max(len(model["trees"]), 1) * model["scale"]))


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeat = counts[:, 0], counts[:, 4]
    return (n < 10) | (100 * repeat > 20 * n)


def stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, counts, ratios, _, _ in text_stats(batch.column("text")):
            passed = ~base_failed(counts)
            part, ratios = batch.slice(i, j - i).filter(pa.array(passed)), ratios[passed]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(ratios[:, k]) for k in range(len(RATIOS))]], names=["doc_id", *RATIOS]
            )


def fit_rules(docs: DataFrame, labels: DataFrame) -> dict:
    """Forest and threshold from all labelled rows.

    Rows that the base rule rejects need no forest and take no part. Statistics meet the labels, so no text is shuffled.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("long").alias("good"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{r} double" for r in RATIOS)
    stats = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(stat_batches, schema)
    return fit_forest(stage(stats.join(known, "doc_id"), "rule-stats"))


def judge(docs: DataFrame, model: dict, filter_only: bool = False) -> DataFrame:
    """Verdicts of every row (or, with ``filter_only``, the kept rows of ``docs`` themselves)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TREES trees of at most 2 * TREE_ROWS nodes

    def verdicts(batches):
        forest = shared.value
        for batch in batches:
            for i, j, counts, ratios, _, _ in text_stats(batch.column("text")):
                part = batch.slice(i, j - i)
                failed = base_failed(counts)
                score = forest_scores(forest, ratios)
                kept = ~failed & (score <= forest["threshold"])
                if filter_only:
                    yield part.filter(pa.array(kept))
                else:
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id"), *[pa.array(counts[:, k].astype(np.int64)) for k in range(len(COUNTS))],
                        pa.array(failed), pa.array(kept), pa.array(score),
                    ], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    if filter_only:
        return docs.mapInArrow(verdicts, docs.schema)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(verdicts, schema + ", base_failed boolean, kept boolean, score double")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base rule, forest score and verdict of every row, over whole texts.

    Rejected: fewer than 10 words, more than a fifth of the words in repeated five-word windows, or a forest score above
    the threshold. Null or empty texts have zero counts and fail the base rule. Repeated rows all stay and agree, empty
    tables give no rows, further columns are ignored; without usable labels the base rule alone decides.
    """
    return judge(docs, fit_rules(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns as given."""
    return judge(docs, fit_rules(docs, labels), filter_only=True)
