"""Exact top-k by inner product over an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
BLOCK = 4096  # vectors of an index block
QUERIES = 1024  # queries of a query block
PACKED = "block long, ids binary, data binary, width int"


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component as double; null where the vector or a component is null or not finite."""
    ok = vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def pack(key, table):
    """All vectors of a block as one row; shorter vectors are filled up with zeros."""
    vectors = [np.array(v, dtype=np.int64) for v in table.column("q").to_pylist()]
    width = max(map(len, vectors))
    data = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        data[i, : len(v)] = v
    ids = np.array(table.column("vec_id").to_pylist(), dtype=np.int64)
    return pa.table({"block": [key[0].as_py()], "ids": [ids.tobytes()], "data": [data.tobytes()], "width": pa.array([width], pa.int32())})


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows packed by about ``size``; the block of a row hangs on its id and components only."""
    n = vectors.count()
    many = max(1, -(-n // size))
    return vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(many))).groupBy("block").applyInArrow(pack, PACKED), many


def segments(v: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Posting segments of a block, by descending quantised impact.

    Segment j holds the postings whose size is in [2**j, 2**(j+1)), as a matrix with zeros elsewhere.
    """
    size = np.abs(v)
    out = []
    for j in range(int(size.max(initial=0)).bit_length() - 1, -1, -1):
        inside = (size >> j) == 1
        if inside.any():
            out.append((j, np.where(inside, v, 0).astype(np.float64)))
    return out


def best_of_block(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score) of each query's best k in the block, a query's own id left out.

    Segments add to all scores in order of impact. What is still missing lies within the bound |query| * |rest of the
    vector| (Cauchy-Schwarz). Once, for every query, few vectors can still reach its k-th lower bound, the possible
    members are rescored exactly; if the bounds never get so tight, all segments are read and the scores are exact.
    """
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
    if int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(width, 1) >= 1 << 52:
        q, v = q.astype(object), v.astype(object)  # beyond exact floating point: whole numbers of any size
        scores = q @ v.T
        possible = [np.flatnonzero(v_ids != q_ids[i]) for i in range(len(q))]
    else:
        f = q.astype(np.float64)
        own = q_ids[:, None] == v_ids[None, :]
        scores, rest = np.zeros((len(q), len(v))), (v.astype(np.float64) ** 2).sum(axis=1)
        length = np.sqrt((f * f).sum(axis=1))
        possible = None
        candidates = min(k, len(v))
        for _, postings in segments(v):
            scores += f @ postings.T
            rest = rest - (postings * postings).sum(axis=1)
            slack = length[:, None] * np.sqrt(np.maximum(rest, 0))[None, :] + 1e-3
            low = np.where(own, -np.inf, scores - slack)
            kth = np.partition(low, len(v) - candidates, axis=1)[:, len(v) - candidates]
            if np.isneginf(kth).any() and rest.any():
                continue
            may = (scores + slack >= kth[:, None]) & ~own
            if not rest.any() or may.mean() * len(v) <= max(8 * k, len(v) / 16):
                possible = [np.flatnonzero(m) for m in may]
                break
        if possible is None:
            possible = [np.flatnonzero(~o) for o in own]
    for i, rows in enumerate(possible):
        exact = (v[rows] @ q[i]) if len(rows) else np.empty(0)
        order = np.lexsort((v_ids[rows], -exact))[:k] if exact.dtype != object else sorted(
            range(len(rows)), key=lambda r: (-exact[r], v_ids[rows[r]]))[:k]
        for r in order:
            yield int(q_ids[i]), int(v_ids[rows[r]]), int(exact[r])


def search(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors; queries: rows whose vec_id is divisible by ``every``.

    Vectors are quantised to whole numbers; null vectors and those with null or non-finite components take no part, nor
    do rows without vec_id. Rows with a query's own vec_id are never its results; a row repeated with the same id and
    vector counts once; vectors of other length are filled up with zeros. Fewer candidates give fewer rows; empty tables
    none; further columns are ignored. Each block of the index meets each block of queries once (a stated query set
    against all rows), and only a block's best k per query leave a task.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("q")).where(
        F.col("q").isNotNull() & F.col("vec_id").isNotNull()
    ).distinct()
    index, _ = blocks(usable, block)
    asked, many = blocks(usable.where(F.col("vec_id") % every == 0), queries)
    asked = asked.select(F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("width").alias("q_width"))
    pairs = index.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))).join(asked, "qb")

    def searched(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at = {n: np.frombuffer(r[n], np.int64) for n in ("ids", "data", "q_ids", "q_data")}
                q, v = at["q_data"].reshape(len(at["q_ids"]), -1), at["data"].reshape(len(at["ids"]), -1)
                hits = list(best_of_block(q, at["q_ids"], v, at["ids"], k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (zip(*hits) if hits else ([], [], []))], names=["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
