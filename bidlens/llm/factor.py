"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.textstats import RATIOS, text_stats

SAMPLE = 8000  # labelled rows the model is fitted on, at most
BITS = 15  # words fall into 2**BITS features
RANK = 8
EPOCHS = 6
STEPS = 8  # cuts of each structure statistic into indicator features
CUT = 0.3
SEED = 29


def word_features(cut: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every hashed word of the rows: log counts, each row scaled to length 1."""
    n = len(cut) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(cut))
    key, times = np.unique((row << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    row, feature, value = key >> BITS, key & ((1 << BITS) - 1), np.log1p(times)
    length = np.sqrt(np.bincount(row, value * value, minlength=n))
    return row, feature, value / np.maximum(length[row], 1e-9)


def dense_features(ratios: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature number of the step each statistic falls into; edges: statistics x (STEPS - 1)."""
    steps = np.stack([np.searchsorted(edges[k], ratios[:, k], side="right") for k in range(ratios.shape[1])], axis=1)
    return (1 << BITS) + np.arange(ratios.shape[1]) * STEPS + steps


def examples(cut, hashes, ratios, edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, feature, value), ordered by row."""
    row, feature, value = word_features(cut, hashes)
    dense = dense_features(ratios, edges)
    rows = np.concatenate((row, np.repeat(np.arange(len(ratios)), dense.shape[1])))
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate((feature, dense.ravel()))[order], np.concatenate((value, np.full(dense.size, 0.3)))[order]


def raw_scores(model: dict, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """w0 + sum w x + 1/2 sum over factors of (sum v x)**2 - sum (v x)**2, in time linear in the features."""
    out = model["w0"] + np.bincount(row, model["w"][feature] * value, minlength=n)
    for f in range(model["v"].shape[1]):
        vx = model["v"][feature, f] * value
        s = np.bincount(row, vx, minlength=n)
        out += 0.5 * (s * s - np.bincount(row, vx * vx, minlength=n))
    return out


def fit_machine(row, feature, value, y: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, seed: int = SEED) -> dict:
    """Logistic loss, one Adagrad step per document and epoch, rows in a fixed random order."""
    size = (1 << BITS) + len(RATIOS) * STEPS
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(size), rng.normal(0, 0.01, (size, rank)), 0.0
    gw, gv, g0 = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    bounds = np.searchsorted(row, np.arange(len(y) + 1))
    rate, decay = 0.1, 1e-4
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, x = feature[bounds[i]: bounds[i + 1]], value[bounds[i]: bounds[i + 1]]
            vf = v[f]
            s = x @ vf
            score = w0 + w[f] @ x + 0.5 * float(s @ s - ((vf * x[:, None]) ** 2).sum())
            d = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[i]
            g0 += d * d
            w0 -= rate * d / np.sqrt(g0)
            grad = d * x + decay * w[f]
            gw[f] += grad * grad
            w[f] -= rate * grad / np.sqrt(gw[f])
            grad = d * (x[:, None] * s - vf * (x * x)[:, None]) + decay * vf
            gv[f] += grad * grad
            v[f] = vf - rate * grad / np.sqrt(gv[f])
    return {"w0": w0, "w": w, "v": v}


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, _, ratios, cut, hashes in text_stats(batch.column("text")):
            row, feature, value = word_features(cut, hashes)
            ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").cast(pa.int64()), part.column("good").cast(pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, ratios.size + 1, ratios.shape[1], dtype=np.int32)), pa.array(ratios.ravel())),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.float32))),
            ], names=["doc_id", "good", "ratios", "feature", "value"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Model from at most ``sample`` labelled rows that are not held out, those with the smallest hash of doc_id."""
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
        .agg(F.max("quality").cast("long").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "good", "text")
    schema = "doc_id long, good long, ratios array<double>, feature array<int>, value array<float>"
    table = rows.mapInArrow(feature_batches, schema).toArrow().combine_chunks()
    size = (1 << BITS) + len(RATIOS) * STEPS
    edges = np.zeros((len(RATIOS), STEPS - 1))
    if not table.num_rows:  # no labels: every text scores one half
        return {"w0": 0.0, "w": np.zeros(size), "v": np.zeros((size, RANK)), "edges": edges}
    table = table.sort_by("doc_id")
    y = table.column("good").to_numpy().astype(float)
    ratios = np.array(table.column("ratios").to_pylist())
    # cuts at quantiles of the good and the bad rows, so that rare bad texts get steps of their own
    for k in range(len(RATIOS)):
        parts = [np.quantile(ratios[y == c, k], q) for c, q in ((1, [0.05, 0.5, 0.95, 0.999]), (0, [0.25, 0.5, 0.75])) if (y == c).any()]
        cuts = np.sort(np.concatenate(parts))
        edges[k] = np.concatenate((cuts, np.full(STEPS - 1 - len(cuts), np.inf)))
    feature, value = table.column("feature").combine_chunks(), table.column("value").combine_chunks()
    lengths = np.diff(feature.offsets.to_numpy())
    row = np.repeat(np.arange(len(y)), lengths)
    dense = dense_features(ratios, edges)
    rows_all = np.concatenate((row, np.repeat(np.arange(len(y)), dense.shape[1])))
    order = np.argsort(rows_all, kind="stable")
    features = np.concatenate((feature.flatten().to_numpy(), dense.ravel()))[order]
    values = np.concatenate((value.flatten().to_numpy(), np.full(dense.size, 0.3)))[order]
    return fit_machine(rows_all[order], features, values, y) | {"edges": edges}


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Features: words of the whole text hashed to 2**BITS places, and steps of the structure statistics of the text
    (length among them). Labels, language, source and doc_id are never inputs. Null or empty texts have no words and
    are scored by their statistics. Repeated rows all stay and agree; empty tables give no rows; further columns are
    ignored. The model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, sample))

    def scores(batches):
        model = shared.value
        for batch in batches:
            for i, j, _, ratios, at, hashes in text_stats(batch.column("text")):
                row, feature, value = examples(at, hashes, ratios, model["edges"])
                s = 1 / (1 + np.exp(-np.clip(raw_scores(model, row, feature, value, j - i), -30, 30)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        scores, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )
