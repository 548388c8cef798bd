"""Embedding whitening with MLlib's BlockMatrix: scatter by transpose-multiply, local eigh, projection by multiplication."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.tables import stage
from bidlens.llm.topk import quantised

BLOCK_BYTES = 4 << 20  # of a block's doubles
GROUP = 4  # blocks of the middle dimension that one task multiplies
LEAST = 1e-11  # components with less than this share of the largest eigenvalue have no variance
BLOCKS = "part long, seq long, ids array<long>, fit binary, data binary, n long, sums array<long>"
MATRIX = T.StructType([
    T.StructField("at", T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])),
    T.StructField("block", MatrixUDT()),
])
_AT = pa.struct([("_1", pa.int64()), ("_2", pa.int64())])
_BLOCK = pa.struct([
    ("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
    ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_()),
])


def matrix_row(row: int, col: int, m: np.ndarray) -> pa.RecordBatch:
    """One block of a BlockMatrix as a row of ``MATRIX``."""
    values = pa.ListArray.from_arrays(pa.array([0, m.size], pa.int32()), pa.array(np.ascontiguousarray(m, np.float64).ravel()))
    none = pa.nulls(1, pa.list_(pa.int32()))
    block = pa.StructArray.from_arrays(
        [pa.array([1], pa.int8()), pa.array([m.shape[0]], pa.int32()), pa.array([m.shape[1]], pa.int32()), none, none, values, pa.array([True])],
        fields=list(_BLOCK))
    at = pa.StructArray.from_arrays([pa.array([row], pa.int64()), pa.array([col], pa.int64())], fields=list(_AT))
    return pa.RecordBatch.from_arrays([at, block], names=["at", "block"])


def pack_blocks(width: int, size: int):
    """Blocks of ``size`` rows of each task: ids, which rows are in the fit list, whole numbers, their count and sums."""

    def batches(source):
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def block(rows: pa.Table) -> pa.RecordBatch:
            x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            fit = rows.column("fit").to_numpy(zero_copy_only=False).astype(bool)
            return pa.RecordBatch.from_pydict({
                "part": [part], "seq": [seq], "ids": [rows.column("vec_id").to_pylist()], "fit": [fit.tobytes()],
                "data": [x.astype(np.int64).tobytes()], "n": [int(fit.sum())], "sums": [x[fit].sum(axis=0).tolist()],
            }, schema=_PACKED)

        waiting = 0
        for batch in source:
            held.append(batch)
            waiting += batch.num_rows
            while waiting >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                seq += 1
                held, waiting = table.slice(size).to_batches(), waiting - size
        if waiting:
            yield block(pa.Table.from_batches(held))

    return batches


_PACKED = pa.schema([
    ("part", pa.int64()), ("seq", pa.int64()), ("ids", pa.list_(pa.int64())), ("fit", pa.binary()), ("data", pa.binary()),
    ("n", pa.int64()), ("sums", pa.list_(pa.int64())),
])


def centred_blocks(blocks: DataFrame, mean: np.ndarray, size: int, side: int | None) -> DataFrame:
    """Rows of ``MATRIX`` with centred vectors. ``side``: the blocks lie on a square grid of that side, with all rows;
    None: they lie one below the other, and only rows of the fit list are filled, all others are zeros."""

    def batches(source):
        for batch in source:
            for r in batch.to_pylist():
                fit = np.frombuffer(r["fit"], bool)
                x = np.frombuffer(r["data"], np.int64).reshape(len(fit), -1)
                full = np.zeros((size, x.shape[1]))
                full[: len(fit)] = x - mean
                if side is None:
                    full[: len(fit)][~fit] = 0.0
                    yield matrix_row(r["b"], 0, full)
                else:
                    yield matrix_row(r["b"] // side, r["b"] % side, full)

    return blocks.select("b", "fit", "data").mapInArrow(batches, MATRIX)


def block_matrix(rows: DataFrame, per_row: int, per_col: int, n_rows: int, n_cols: int) -> BlockMatrix:
    return BlockMatrix(callMLlibFunc("createBlockMatrix", rows, per_row, per_col, n_rows, n_cols), per_row, per_col)


def multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """Product whose middle dimension is dealt to ``splits`` groups, so that no task holds all blocks of a result."""
    product = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def scatter(blocks: DataFrame, mean: np.ndarray, size: int, n_blocks: int) -> np.ndarray:
    """Sum of the outer products of the centred rows of the fit list."""
    width = len(mean)
    tall = block_matrix(centred_blocks(blocks, mean, size, None), size, width, n_blocks * size, width)
    return multiply(tall.transpose(), tall, -(-n_blocks // GROUP)).toLocalMatrix().toArray()


def projected(spark: SparkSession, blocks: DataFrame, mean: np.ndarray, to: np.ndarray, size: int, n_blocks: int) -> DataFrame:
    """(b, m): each block's centred rows times ``to``.

    MLlib deals the blocks of a product by cells of its grid, and a column of blocks makes few cells. So the blocks lie on
    a square grid, and the matrix to multiply with stands on the diagonal once per column of the grid.
    """
    width, k = to.shape
    side = max(1, int(np.ceil(np.sqrt(n_blocks))))

    def diagonal(source):
        for batch in source:
            for i in batch.column(0).to_pylist():
                yield matrix_row(i, i, to)

    square = block_matrix(centred_blocks(blocks, mean, size, side), size, width, side * size, side * width)
    matrix = block_matrix(spark.range(0, side, 1, 1).mapInArrow(diagonal, MATRIX), width, k, side * width, side * k)
    out = callMLlibFunc("getMatrixBlocks", multiply(square, matrix, 1)._java_matrix_wrapper._java_model)
    return out.select((F.col("_1._1").cast("long") * side + F.col("_1._2")).alias("b"), F.col("_2").alias("m"))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum over dimensions of (n * x - sums)**2 of each row, as exact whole numbers.

    With sums = n * m + r and y = x - m it is n**2 * sum(y**2) - 2 * n * sum(y * r) + sum(r**2); both sums over y are
    taken in 64 bits where they fit and in Python's whole numbers else.
    """
    m, r = [s // n for s in sums], [s % n for s in sums]
    span = int(np.abs(x).max(initial=0)) + max(map(abs, m), default=0)
    kind = np.int64 if span * max(span, n) * max(x.shape[1], 1) < 1 << 62 else object
    y = x.astype(kind) - np.array(m, dtype=kind)
    squares, mixed = (y * y).sum(axis=1), (y * np.array(r, dtype=kind)).sum(axis=1)
    rest = sum(v * v for v in r)
    return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares, mixed)]


def whitened_rows(width: int, k: int, n: int, sums: list[int]):
    def batches(source):
        for batch in source:
            for r in batch.to_pylist():
                fit = np.frombuffer(r["fit"], bool)
                x = np.frombuffer(r["data"], np.int64).reshape(len(fit), width)
                m = r["m"]
                values = np.array(m["values"]).reshape((m["numRows"], m["numCols"]) if m["isTransposed"] else (m["numCols"], m["numRows"]))
                w = (values if m["isTransposed"] else values.T)[: len(fit)]
                exact = deviations(x, n, sums)
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["ids"], pa.int64()), pa.array(fit),
                    pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()),
                    pa.array([Decimal(d) if d < 10 ** 38 else None for d in exact], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(fit) * k + 1, k, dtype=np.int32)), pa.array(np.ascontiguousarray(w).ravel())),
                ], names=["vec_id", "fit", "deviation", "deviation_exact", "w"])

    return batches


def covariance(rows: DataFrame, column: str, k: int, n: int) -> np.ndarray:
    """Covariance (divisor n) of an array column of k entries; centred before multiplying."""
    mean = rows.agg(*[(F.sum(F.col(column)[i]) / n).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(*[F.sum((F.col(column)[i] - mean[i]) * (F.col(column)[j] - mean[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), s in zip(pairs, sums):
        out[i, j] = out[j, i] = s / n
    return out


OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "deviation_exact decimal(38,0)"
)


def whiten(vectors: DataFrame, components: int = 4, block: int | None = None) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A component c of a vector becomes floor(256 * c). The fit list holds each distinct vector once; n, sums, covariance
    (divisor n, centred first) and the covariance behind ``identity_error`` are over it, while every usable row is
    projected. Components are numbered by falling eigenvalue; those without variance are left out, so there may be fewer.
    ``block``: vectors of a block (as many as make 4 MB by default).

    Null vectors and those with null or non-finite components are dropped; a null vec_id stays null; repeated rows all stay
    (and count once in the fit); shorter vectors are filled up with zeros; empty tables, and tables of one distinct vector,
    give no rows; further columns are ignored. ``deviation`` is null where it is beyond a long, ``deviation_exact`` then
    still has it (to 38 digits).
    """
    spark = vectors.sparkSession
    usable = stage(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("x"), F.monotonically_increasing_id().alias("row")
    ).where(F.col("x").isNotNull()), "vectors")
    width = usable.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], OUT)
    filled = usable.select("vec_id", "row", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x"))
    firsts = filled.groupBy("x").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("fit"))
    flagged = filled.join(firsts, "row", "left").select("vec_id", F.coalesce("fit", F.lit(False)).alias("fit"), "x")
    size = block or max(1, BLOCK_BYTES // (8 * width))
    packed = stage(flagged.mapInArrow(pack_blocks(width, size), BLOCKS), "blocks")
    n, parts, most = packed.agg(F.sum("n"), F.max("part") + 1, F.max("seq") + 1).first()
    sums = [0] * width
    for at, s in packed.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s")).collect():
        sums[at] = int(s)  # one row per dimension
    mean = np.array([s / n for s in sums])
    blocks = packed.withColumn("b", F.col("seq") * parts + F.col("part"))  # absent numbers are empty blocks
    n_blocks = parts * most
    spread = scatter(blocks, mean, size, n_blocks) / n
    values, axes = np.linalg.eigh(spread)
    order = np.argsort(values)[::-1][:components]
    order = [int(i) for i in order if values[i] > 0 and values[i] > LEAST * values.max()]
    if not order:
        return spark.createDataFrame([], OUT)
    k = len(order)
    rows = stage(
        blocks.select("b", "ids", "fit", "data").join(projected(spark, blocks, mean, axes[:, order] / np.sqrt(values[order]), size, n_blocks), "b")
        .mapInArrow(whitened_rows(width, k, n, sums), "vec_id long, fit boolean, deviation long, deviation_exact decimal(38,0), w array<double>"),
        "whitened")
    error = float(np.abs(covariance(rows.where("fit"), "w", k, n) - np.eye(k)).max())
    explained = F.array(*[F.lit(float(values[i] / np.trace(spread))) for i in order])
    return rows.select("vec_id", F.posexplode("w").alias("at", "whitened"), "deviation", "deviation_exact").select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(int(n)).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )
