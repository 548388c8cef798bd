"""Boosted trees for ranking: lambda gradients per result list, split histograms merged over all tasks, trees as a table.

The driver sees histograms only (nodes x features x bins, whatever the number of rows). A fitted model is a table of nodes,
which scores rows as one Spark expression and gives exact path-wise Shapley values.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import dicts
from bidlens.session import cut_lineage

HEAD = 30  # rows of a list's top that all others are compared with
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover long, gain double"


@dataclass
class TreeNode:
    """Rows with feature <= threshold go left; a leaf has feature -1 and a value. ``cover``: training rows that came by."""

    tree: int
    node: int
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    value: float = 0.0
    cover: int = 0
    gain: float = 0.0


def feature_cuts(pairs: DataFrame, bins: int) -> list[list[float]]:
    """Thresholds of each feature: its quantiles, at most ``bins`` - 1 of them."""
    found = pairs.approxQuantile(dicts.FEATURES, [k / bins for k in range(1, bins)], 0.002)
    return [sorted(set(q)) for q in found]


def bin_of(value: Column, cuts: list[float]) -> Column:
    """How many thresholds lie below a value."""
    return F.size(F.filter(F.lit(cuts), lambda t: t < value)) if cuts else F.lit(0)


def lambdas(group: pa.Table) -> pa.Table:
    """First and second derivatives of the pairwise loss, each pair weighted by the NDCG that swapping it would change.

    A group is one result list, bounded by its candidate pool; pairs have one of the first ``HEAD`` rows at least, as only
    those move the metric.
    """
    scores = group.column("score").to_numpy()
    order = np.lexsort((group.column("item_id").to_numpy(), -scores))
    gain = np.power(2.0, group.column("relevance").to_numpy()[order].astype(float)) - 1
    discount = 1 / np.log2(np.arange(len(gain)) + 2)
    ideal = (np.sort(gain)[::-1] * discount).sum()
    s = scores[order]
    top = min(HEAD, len(s))
    sign = np.sign(gain[:top, None] - gain[None, :])
    sign[:, :top] = np.triu(sign[:, :top], 1)  # two rows of the head meet once
    swing = np.abs(gain[:top, None] - gain[None, :]) * np.abs(discount[:top, None] - discount[None, :]) / max(ideal, 1e-12)
    rho = 1 / (1 + np.exp(np.clip(sign * (s[:top, None] - s[None, :]), -50, 50)))
    first, second = sign * rho * swing, np.abs(sign) * rho * (1 - rho) * swing
    g, h = -first.sum(axis=0), second.sum(axis=0)
    g[:top] += first.sum(axis=1)
    h[:top] += second.sum(axis=1)
    back = np.argsort(order)
    return group.append_column("g", pa.array(g[back])).append_column("h", pa.array(h[back]))


def walk(nodes: list[TreeNode], test, leaf) -> Column:
    """Nested conditions of one tree; ``test(node)`` is true where rows go left."""
    by = {n.node: n for n in nodes}

    def at(k: int) -> Column:
        n = by[k]
        return leaf(n) if n.feature < 0 else F.when(test(n), at(n.left)).otherwise(at(n.right))

    return at(0)


def histograms(grown: list[TreeNode], cut_bin: dict[int, int], open_: list[int], bins: int):
    """Per task: sums of g, h and rows by open node, feature and bin."""

    def batches(source):
        slot = {k: i for i, k in enumerate(open_)}
        sums = np.zeros((3, len(open_) * len(dicts.FEATURES) * bins))
        for batch in source:
            if not batch.num_rows:
                continue
            x = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, -1)
            node = np.zeros(len(x), np.int64)
            for n in grown:  # parents come before their children
                if n.feature >= 0:
                    here = node == n.node
                    node[here] = np.where(x[here, n.feature] <= cut_bin[n.node], n.left, n.right)
            place = np.full(len(grown), -1)
            place[open_] = range(len(open_))
            mine = place[node]
            use = mine >= 0
            at = ((mine[use, None] * x.shape[1] + np.arange(x.shape[1])) * bins + x[use]).ravel()
            for k, w in enumerate((batch.column("g").to_numpy()[use], batch.column("h").to_numpy()[use], np.ones(int(use.sum())))):
                sums[k] += np.bincount(at, weights=np.repeat(w, x.shape[1]), minlength=sums.shape[1])
        at = np.flatnonzero(sums[2])
        node, feature, place = np.unravel_index(at, (len(slot), len(dicts.FEATURES), bins))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(open_)[node]), pa.array(feature), pa.array(place), *[pa.array(s[at]) for s in sums]], names=["node", "feature", "bin", "g", "h", "n"])

    return batches


def best_splits(histogram: pd.DataFrame, cuts: list[list[float]], l2: float, least: int) -> dict[int, tuple]:
    """(gain, feature, bin, totals) of each node's best split; histogram: node, feature, bin, g, h, n."""
    out = {}
    for node, rows in histogram.groupby("node"):
        one = rows[rows["feature"] == rows["feature"].iloc[0]]
        g, h, n = (float(one[c].sum()) for c in "ghn")
        best = (0.0, -1, -1)
        for feature, sub in rows.groupby("feature"):
            sub = sub.sort_values("bin")
            gl, hl, nl = (sub[c].cumsum().to_numpy()[:-1] for c in "ghn")
            if len(gl):
                gains = gl ** 2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g ** 2 / (h + l2)
                gains = np.where((nl >= least) & (n - nl >= least), gains, -1.0)
                k = int(gains.argmax())
                if gains[k] > best[0] + 1e-12:
                    best = (float(gains[k]), int(feature), int(sub["bin"].iloc[k]))
        out[int(node)] = (*best, g, h, int(n))
    return out


def fit_lambda_trees(
    pairs: DataFrame, trees: int = 10, depth: int = 4, bins: int = 32, rate: float = 0.3, l2: float = 0.1, least: int = 20,
) -> list[TreeNode]:
    """Nodes of trees fitted on (group_id, item_id, relevance, features); groups without two labels give no gradient."""
    cuts = feature_cuts(pairs, bins)
    place = [bin_of(F.col(f), c) for f, c in zip(dicts.FEATURES, cuts)]
    state = cut_lineage(pairs.select("group_id", "item_id", "relevance", F.array(*place).alias("bins"), F.lit(0.0).alias("score")), "binned")
    schema = f"{state._jdf.schema().toDDL()}, g double, h double"
    model: list[TreeNode] = []
    for t in range(trees):
        rows = cut_lineage(state.groupBy("group_id").applyInArrow(lambdas, schema), "lambdas")
        grown, open_ = [TreeNode(t, 0)], [0]
        cut_bin: dict[int, int] = {}
        for level in range(depth + 1):
            seen = rows.select("bins", "g", "h").mapInArrow(
                histograms(grown, cut_bin, open_, bins), "node long, feature long, bin long, g double, h double, n double")
            histogram = seen.groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas()
            found, after = best_splits(histogram, cuts, l2, least), []
            for k in open_:
                gain, feature, at_bin, g, h, n = found[k]
                node = grown[k]
                node.value, node.cover = rate * g / (h + l2), n
                if level < depth and feature >= 0:
                    node.feature, node.threshold, node.gain = feature, cuts[feature][at_bin], gain
                    node.left, node.right = len(grown), len(grown) + 1
                    cut_bin[k] = at_bin
                    grown += [TreeNode(t, node.left), TreeNode(t, node.right)]
                    after += [node.left, node.right]
            open_ = after
            if not open_:
                break
        model += grown
        value = walk(grown, lambda n: F.col("bins")[n.feature] <= cut_bin[n.node], lambda n: F.lit(n.value))
        state = rows.withColumn("score", F.col("score") + value).drop("g", "h")
    return model


def node_table(spark, model: list[TreeNode]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(n).values()) for n in model], NODES)


def read_nodes(table: DataFrame) -> list[TreeNode]:
    """The model of a node table, which is as large as the model, not the data."""
    return [TreeNode(**r.asDict()) for r in table.orderBy("tree", "node").collect()]


def by_tree(model: list[TreeNode]) -> list[list[TreeNode]]:
    return [[n for n in model if n.tree == t] for t in sorted({n.tree for n in model})]


def trees_score(model: list[TreeNode]) -> Column:
    """Sum of the trees' leaf values of a row, as one expression over the feature columns."""
    left = lambda n: F.col(dicts.FEATURES[n.feature]) <= n.threshold
    total = F.lit(0.0)
    for tree in by_tree(model):
        total = total + walk(tree, left, lambda n: F.lit(n.value))
    return total


def importances(model: list[TreeNode]) -> list[tuple[str, float]]:
    """Share of each feature in the gain of all splits."""
    gains = [sum(n.gain for n in model if n.feature == k) for k in range(len(dicts.FEATURES))]
    return [(f, g / max(sum(gains), 1e-12)) for f, g in zip(dicts.FEATURES, gains)]


# ---- Shapley values --------------------------------------------------------------------------
def leaf_paths(tree: list[TreeNode]) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Each leaf's value and, per feature on its path, the interval (low, high] and the share of rows that follow it."""
    by, out = {n.node: n for n in tree}, []

    def down(k: int, path: dict) -> None:
        n = by[k]
        if n.feature < 0:
            out.append((n.value, path))
            return
        low, high, share = path.get(n.feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((n.left, (low, min(high, n.threshold))), (n.right, (max(low, n.threshold), high))):
            down(child, {**path, n.feature: (*bounds, share * by[child].cover / max(n.cover, 1))})

    down(0, {})
    return out


def shapley(model: list[TreeNode], x: np.ndarray) -> np.ndarray:
    """Path-wise Shapley values of a batch of rows (rows x features): a feature that is left out follows both branches by
    their share of training rows. Leaves have few features on their path (at most the depth), so all subsets are taken."""
    out = np.zeros(x.shape)
    for tree in by_tree(model):
        for value, path in leaf_paths(tree):
            features = list(path)
            inside = {f: ((x[:, f] > path[f][0]) & (x[:, f] <= path[f][1])).astype(float) for f in features}
            for f in features:
                others, weight = [o for o in features if o != f], np.zeros(len(x))
                for size in range(len(others) + 1):
                    share = factorial(size) * factorial(len(others) - size) / factorial(len(features))
                    for chosen in combinations(others, size):
                        part = np.full(len(x), share)
                        for o in others:
                            part *= inside[o] if o in chosen else path[o][2]
                        weight += part
                out[:, f] += value * (inside[f] - path[f][2]) * weight
    return out


def mean_score(model: list[TreeNode]) -> float:
    """What the trees give on average over the training rows: the base that Shapley values add to."""
    total = 0.0
    for tree in by_tree(model):
        for value, path in leaf_paths(tree):
            total += value * float(np.prod([share for _, _, share in path.values()]))
    return total


def with_shapley(model: list[TreeNode], rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shap): an array of one value per feature for every row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def batches(source):
        for batch in source:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in dicts.FEATURES])
            values = shapley(model, x)
            ends = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=[*keys, "shap"])

    return rows.select(*keys, *dicts.FEATURES).mapInArrow(batches, f"{fields}, shap array<double>")


def top_shapley(model: list[TreeNode], rows: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The ``k`` features of the largest values of each row: (keys, place, feature, value), ties in order of features."""
    parts = F.transform("shap", lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("i"), v.alias("v")))
    ranked = with_shapley(model, rows, keys).select(*keys, F.slice(F.array_sort(parts), 1, k).alias("top"))
    named = F.element_at(F.array(*[F.lit(f) for f in dicts.FEATURES]), F.col("c.i") + 1)
    return ranked.select(*keys, F.posexplode("top").alias("p", "c")).select(*keys, (F.col("p") + 1).alias("place"), named.alias("feature"), F.col("c.v").alias("value"))
