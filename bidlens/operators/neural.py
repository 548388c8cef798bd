"""A small neural ranker fitted on preferences: gradients are summed over tasks, the weights (929 numbers) stay on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import dicts
from bidlens.session import cut_lineage

SIZES = (len(dicts.FEATURES), 32, 16, 1)


def first_weights(seed: int = 42) -> list[np.ndarray]:
    """Weights and biases layer by layer, drawn with variance 2 / (inputs + outputs)."""
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    for a, b in zip(SIZES, SIZES[1:]):
        out += [rng.normal(size=(a, b)) * np.sqrt(2 / (a + b)), np.zeros(b)]
    return out


def forward(weights: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Outputs of all layers, inputs first; rectified but for the last."""
    layers = [x]
    for k in range(0, len(weights), 2):
        z = layers[-1] @ weights[k] + weights[k + 1]
        layers.append(z if k == len(weights) - 2 else np.maximum(z, 0))
    return layers


def backward(weights: list[np.ndarray], layers: list[np.ndarray], d: np.ndarray) -> list[np.ndarray]:
    """Gradient of the weights from that of the scores."""
    out: list[np.ndarray] = []
    for k in range(len(weights) - 2, -1, -2):
        below = layers[k // 2]
        out = [below.T @ d, d.sum(axis=0), *out]
        d = (d @ weights[k].T) * (below > 0)
    return out


BLOCK = 512  # items of a group that meet each other in one row; a larger group gives a row per pair of its blocks


def preferences(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(members: within, relevance, x): labelled items whose pairs of unlike labels are preferences, every pair in one row.

    A group of at most ``block`` items is one row. A larger one is cut into blocks and gives a row for each block and for
    each two of them; ``within`` is null in the row of one block, else tells which of the two an item is from.
    """
    group = W.partitionBy("group_id")
    rows = pairs.where("relevance is not null").select(
        "group_id", "item_id", "relevance", F.array(*dicts.FEATURES).alias("x"),
        F.floor((F.row_number().over(group.orderBy("item_id")) - 1) / block).cast("int").alias("part"),
        F.ceil(F.count("*").over(group) / block).cast("int").alias("parts"),
    )
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    within = F.when(F.col("part") != F.col("other"), F.col("part") > F.col("other"))
    member = F.struct("item_id", within.alias("within"), "relevance", "x")
    return met.groupBy("group_id", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).agg(
        F.sort_array(F.collect_list(member)).alias("members"), F.min("relevance").alias("least"), F.max("relevance").alias("most"),
    ).where("least < most").select(F.transform("members", lambda m: m.dropFields("item_id")).alias("members"))


def _members(column: pa.Array):
    """Per row: features, labels and sides of its items."""
    items, ends = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
    x = items.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)
    labels = items.field("relevance").to_numpy(zero_copy_only=False)
    side = items.field("within").cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)
    for low, high in zip(ends, ends[1:]):
        yield x[low:high], labels[low:high], side[low:high]


def meetings(labels: np.ndarray, side: np.ndarray):
    """(better, worse): items of which all of the first are preferred to all of the second, each preference once."""
    for level in np.unique(labels)[1:]:
        for own, other in ((-1, -1), (0, 1), (1, 0)):
            better, worse = np.flatnonzero((labels == level) & (side == own)), np.flatnonzero((labels < level) & (side == other))
            if len(better) and len(worse):
                yield better, worse


def gradient_sums(weights: list[np.ndarray]):
    """Per task: gradient of the sum of log(1 + exp(worse - better)), the loss itself and the number of preferences.

    An item is scored once for all its preferences.
    """

    def batches(source):
        total = np.zeros(sum(w.size for w in weights) + 2)
        for batch in source:
            for x, labels, side in _members(batch.column("members")) if batch.num_rows else ():
                layers = forward(weights, x)
                scores, d, loss, count = layers[-1][:, 0], np.zeros(len(x)), 0.0, 0
                for better, worse in meetings(labels, side):
                    odds = np.exp(np.clip(scores[worse][None, :] - scores[better][:, None], -50, 50))
                    pull = odds / (1 + odds)
                    d[better] -= pull.sum(axis=1)
                    d[worse] += pull.sum(axis=0)
                    loss, count = loss + np.log1p(odds).sum(), count + odds.size
                total += np.concatenate([*[g.ravel() for g in backward(weights, layers, d[:, None])], [loss, count]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["sums"])

    return batches


def fit_net(pairs: DataFrame, rounds: int = 40, rate: float = 0.03, decay: float = 1e-4) -> list[np.ndarray]:
    """Weights of the net after ``rounds`` full passes of Adam over all preferences."""
    rows = cut_lineage(preferences(pairs), "preferences")
    weights = first_weights()
    flat = np.concatenate([w.ravel() for w in weights])
    m, v = np.zeros(len(flat)), np.zeros(len(flat))
    for step in range(1, rounds + 1):
        sums = rows.mapInArrow(gradient_sums(weights), "sums array<double>").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(
            F.sum("s").alias("s")).toPandas().sort_values("at")["s"].to_numpy()
        if not len(sums) or not sums[-1]:
            break
        g = sums[:-2] / sums[-1] + decay * flat
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        weights = shaped(flat)
    return weights


def shaped(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for a, b in zip(SIZES, SIZES[1:]):
        out += [flat[at: at + a * b].reshape(a, b), flat[at + a * b: at + a * b + b]]
        at += a * b + b
    return out


def weight_table(spark, weights: list[np.ndarray]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(float(x) for w in weights for x in w.ravel())), "at int, weight double")


def read_weights(table: DataFrame) -> list[np.ndarray]:
    return shaped(np.array([r.weight for r in table.orderBy("at").collect()]))


def net_score(weights: list[np.ndarray]) -> Column:
    """The net as one Spark expression over the feature columns."""
    out = F.array(*[F.col(f).cast("double") for f in dicts.FEATURES])
    for k in range(0, len(weights), 2):
        rows = F.array(*[F.lit([*map(float, col), float(bias)]) for col, bias in zip(weights[k].T, weights[k + 1])])
        n = weights[k].shape[0]
        inputs = F.concat(out, F.array(F.lit(1.0)))  # the bias is the weight of a constant input
        dot = lambda row: F.aggregate(F.zip_with(inputs, row, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)  # noqa: B023, E731
        last = k == len(weights) - 2
        out = F.transform(rows, lambda row: dot(row) if last else F.greatest(dot(row), F.lit(0.0)))  # noqa: B023
        assert n == SIZES[k // 2]
    return out[0]


def preference_share(scored: DataFrame, column: str, per_item: int = 5) -> float:
    """Share of preferences that a score column orders rightly (ties count half)."""
    order = W.partitionBy("group_id").orderBy(F.md5(F.concat_ws("|", "group_id", "item_id")))
    ahead = F.array(*[F.lead(F.struct("relevance", F.col(column).alias("s")), n).over(order) for n in range(1, per_item + 1)])
    met = scored.withColumn("ahead", ahead).withColumn("o", F.explode("ahead")).where("o is not null and o.relevance <> relevance")
    gap = (F.col(column) - F.col("o.s")) * F.when(F.col("relevance") > F.col("o.relevance"), 1).otherwise(-1)
    return met.agg(F.avg(F.when(gap > 0, 1.0).when(gap == 0, 0.5).otherwise(0.0))).first()[0]
