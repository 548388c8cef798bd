"""Hard-negative mining over a GNAT-style tree: many split points a node, distance ranges to sibling subtrees, exact leaves.

Inner products become distances: with one more coordinate sqrt(M**2 - |x|**2) every row has length M, and an anchor a (0
there) lies at sqrt(|a|**2 + M**2 - 2 * score) from it. A window of scores is then an annulus around the anchor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from bidlens.llm.tables import stage
from bidlens.llm.topk import quantised

SAMPLE = 8192  # rows that choose split points and give first bounds
SPLITS = 8  # split points of a node
LEAF_SAMPLE = 48  # sample rows below which a node is a leaf
BLOCK = 4096  # rows of a part of a leaf
ANCHORS = 256  # anchors of a block of anchors
EXACT = 1 << 52  # products up to this are exact in double precision
LONGEST = 1 << 62  # squared length from which scores would not fit into a long
MESSAGE = 8 << 20  # bytes of anchors that leave a task together
NONE = np.iinfo(np.int64).min


@dataclass
class Node:
    points: np.ndarray  # split points, with the added coordinate
    children: list = field(default_factory=list)  # a Node, or the number of a leaf
    low: np.ndarray | None = None  # [i, j]: least and greatest distance from split point i to rows under child j
    high: np.ndarray | None = None
    number: int = 0


@dataclass
class Tree:
    root: Node | int
    top: float  # length M of every row with its added coordinate
    width: int
    nodes: list = field(default_factory=list)
    leaves: int = 0
    exact: bool = True  # all products fit into double precision; otherwise nothing is pruned

    @property
    def slack(self) -> float:
        return 1e-5 * self.top + 1e-6

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack((x, np.sqrt(np.maximum(self.top ** 2 - (x * x).sum(axis=1), 0))))

    def leaf_of(self, x: np.ndarray, visit=None) -> np.ndarray:
        """Leaf of each row: always the child of the nearest split point. ``visit(node, distances, child)`` sees each step."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        high = self.lifted(x)
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            far = distances(high[rows], node.points)
            child = far.argmin(axis=1)
            if visit is not None:
                visit(node, far, child)
            todo += [(c, rows[child == j]) for j, c in enumerate(node.children) if (child == j).any()]
        return out

    def leaves_within(self, anchors: np.ndarray, near: np.ndarray, far: np.ndarray, owner: np.ndarray):
        """(leaf, annuli) for the annuli (``near`` to ``far`` around the anchor ``owner``) that may meet the leaf's rows."""
        points = np.column_stack((anchors.astype(np.float64), np.zeros(len(anchors))))
        todo = [(self.root, np.arange(len(near)))]
        while todo:
            node, live = todo.pop()
            if isinstance(node, int):
                yield node, live
                continue
            d = distances(points, node.points)[owner[live]]
            least = np.maximum(d - far[live, None], near[live, None] - d) - self.slack
            most = d + far[live, None] + self.slack
            meets = ((node.low[None] <= most[:, :, None]) & (node.high[None] >= least[:, :, None])).all(axis=1)
            todo += [(c, live[meets[:, j]]) for j, c in enumerate(node.children) if meets[:, j].any()]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def grown(sample: np.ndarray, top: float, width: int, exact: bool) -> Tree:
    """Tree whose split points are rows of the sample, chosen one after the other as the farthest from those before."""
    tree = Tree(0, top, width, exact=exact)
    high = tree.lifted(sample)

    def node(rows: np.ndarray):
        if len(rows) > LEAF_SAMPLE and exact:
            chosen, gap = [rows[0]], distances(high[rows], high[rows[:1]])[:, 0]
            while len(chosen) < SPLITS and gap.max() > tree.slack:
                chosen.append(rows[gap.argmax()])
                gap = np.minimum(gap, distances(high[rows], high[chosen[-1:]])[:, 0])
            if len(chosen) > 1:
                points = high[np.array(chosen)]
                child = distances(high[rows], points).argmin(axis=1)
                made = Node(points, number=len(tree.nodes))
                tree.nodes.append(made)
                made.children = [node(rows[child == j]) for j in range(len(points))]
                return made
        tree.leaves += 1
        return tree.leaves - 1

    tree.root = node(np.arange(len(sample)))
    return tree


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Whole-number vectors of a list column as rows of a matrix, shorter ones filled up with zeros."""
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(ends)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1], sizes)] = flat
    return out


def dropped(tree: Tree):
    """Rows with the leaf that they fall into."""

    def batches(source):
        for batch in source:
            if batch.num_rows:
                x = matrix(batch.column("x"), tree.width)
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(x)), *[batch.column(c) for c in ROW]], names=["leaf", *ROW])

    return batches


ROW = ["vec_id", "tag", "label", "x"]


def measured(tree: Tree):
    """Least and greatest distance from each split point to the rows under each child, of the rows of a task."""

    def batches(source):
        low = [np.full((len(n.points),) * 2, np.inf) for n in tree.nodes]
        high = [np.full((len(n.points),) * 2, -np.inf) for n in tree.nodes]

        def visit(node, far, child):
            for j in np.unique(child):
                rows = far[child == j]
                low[node.number][:, j] = np.minimum(low[node.number][:, j], rows.min(axis=0))
                high[node.number][:, j] = np.maximum(high[node.number][:, j], rows.max(axis=0))

        for batch in source:
            if batch.num_rows:
                tree.leaf_of(matrix(batch.column("x"), tree.width), visit)
        out = [(k, i, j, low[k][i, j], high[k][i, j]) for k in range(len(low)) for i, j in np.argwhere(np.isfinite(low[k]))]
        node, i, j, least, most = zip(*out) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(node, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(least, pa.float64()), pa.array(most, pa.float64())],
            names=["node", "i", "j", "low", "high"])

    return batches


def ranged(tree: Tree, rows: DataFrame) -> Tree:
    """The tree with the distance ranges of all rows; a child without rows meets nothing."""
    for n in tree.nodes:
        n.low, n.high = np.full((len(n.points),) * 2, np.inf), np.full((len(n.points),) * 2, -np.inf)
    seen = rows.select("x").mapInArrow(measured(tree), "node int, i int, j int, low double, high double").groupBy("node", "i", "j").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).collect()  # nodes x split points**2, bounded by SAMPLE
    for r in seen:
        tree.nodes[r.node].low[r.i, r.j], tree.nodes[r.node].high[r.i, r.j] = r.low, r.high
    return tree


def packed(width: int):
    """A part of a leaf as one row, its rows in order of vec_id."""

    def block(key, table):
        table = table.sort_by([("vec_id", "ascending"), ("tag", "ascending")])
        x = matrix(table.column("x").combine_chunks(), width)
        as_bytes = lambda c: table.column(c).to_numpy().astype(np.int64).tobytes()
        return pa.table({"leaf": [key[0].as_py()], "part": [key[1].as_py()], "ids": [as_bytes("vec_id")], "tags": [as_bytes("tag")],
                         "labels": [as_bytes("label")], "data": [x.tobytes()]})

    return block


PACKED = "leaf long, part long, ids binary, tags binary, labels binary, data binary"


def with_part(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows with what ``leaves`` (l, parts) says of their leaf and their part of it; leaves are bounded by SAMPLE, so they
    are what is broadcast: the files of the rows may be many times smaller than the rows."""
    return rows.join(F.broadcast(leaves), F.col("leaf") == F.col("l")).withColumn("part", F.pmod(F.xxhash64("vec_id", "tag"), F.col("parts"))).drop("l", "parts")


def in_parts(rows: DataFrame, parts: dict[int, int]) -> DataFrame:
    """Rows with the part of their leaf; a leaf with many rows has many parts."""
    many = rows.sparkSession.createDataFrame([(k, v) for k, v in parts.items()], "l long, parts long")  # one row per leaf
    return with_part(rows, many)


def parts_of(rows: DataFrame, size: int) -> dict[int, int]:
    return {r.leaf: max(1, -(-r["count"] // size)) for r in rows.groupBy("leaf").count().collect()}  # one row per leaf


def in_groups(rows: DataFrame, size: int) -> DataFrame:
    """Rows dealt to groups (columns group, part) of about ``size`` from leaves next to each other in the tree; a leaf with
    more rows is a group of several parts."""
    groups, group, held = [], 0, 0
    for r in sorted(rows.groupBy("leaf").count().collect(), key=lambda r: r.leaf):  # one row per leaf
        if held and held + r["count"] > size:
            group, held = group + 1, 0
        held += r["count"]
        groups.append((r.leaf, group, max(1, -(-r["count"] // size))))
    of = rows.sparkSession.createDataFrame(groups, "l long, group long, parts long")
    return with_part(rows, of)


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(object) @ x.astype(object).T


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row; of equal ones the first columns."""
    n = scores.shape[1]
    if scores.dtype != object and int(np.abs(scores).max(initial=0)) < (1 << 61) // max(n, 1):
        keys = np.where(allowed, scores * n + (n - 1 - np.arange(n))[None, :], NONE)
        top = np.sort(np.partition(keys, n - k, axis=1)[:, n - k:], axis=1)[:, ::-1] if n > k else -np.sort(-keys, axis=1)
        row, at = np.nonzero(top != NONE)
        return row, n - 1 - top[row, at] % n
    rows, cols = [], []
    for i in range(len(scores)):
        order = sorted(np.flatnonzero(allowed[i]), key=lambda c: (-scores[i, c], c))[:k]
        rows += [i] * len(order)
        cols += order
    return np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)


@dataclass
class Asked:
    """Windows of scores around a block of anchors."""

    ids: np.ndarray
    tags: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    owner: np.ndarray  # anchor of each window
    name: np.ndarray  # which of its anchor's windows it is
    low: np.ndarray
    high: np.ndarray
    alike: bool  # rows of the anchor's label are looked for, else all others

    def allowed(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        fits = self.labels[self.owner][:, None] == labels[None, :]
        return (fits if self.alike else ~fits) & (self.ids[self.owner][:, None] != ids[None, :]) & (
            scores >= self.low[:, None]) & (scores <= self.high[:, None])

    def bounded(self, tree: Tree, sample: tuple[np.ndarray, ...], k: int) -> Asked:
        """Windows cut at their k-th best row of the sample: what scores less cannot be among the first k."""
        ids, labels, x = sample
        scores = products(self.x, x, tree.exact)[self.owner]
        row, col = best(scores, self.allowed(scores, ids, labels), k)
        found = np.bincount(row, minlength=len(self.owner))
        last = np.append(np.flatnonzero(np.diff(row)), len(row) - 1) if len(row) else np.empty(0, np.int64)
        low = self.low.copy()
        full = last[found[row[last]] == k] if len(row) else last
        low[row[full]] = np.maximum(low[row[full]], scores[row[full], col[full]])
        self.low = low
        return self

    def annuli(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        square = (self.x.astype(np.float64) ** 2).sum(axis=1)[self.owner] + tree.top ** 2
        radius = lambda s: np.sqrt(np.maximum(square - 2 * s.astype(np.float64), 0))
        return radius(self.high), radius(self.low)


ASKED = "leaf long, part long, a_ids binary, a_tags binary, a_labels binary, a_data binary, owner binary, name binary, low binary, high binary"


def _asked(columns: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64()] + [pa.binary()] * (len(columns) - 2)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in ASKED.split(", ")])


def routed(tree: Tree, parts: dict[int, int], sample: tuple[np.ndarray, ...], k: int, alike: bool):
    """For each block of anchors and each part of a leaf that one of its windows may meet: those windows and their anchors."""

    def batches(source):
        for batch in source:
            for r in batch.to_pylist():
                a = {c: np.frombuffer(r[c], np.int64) for c in ("ids", "tags", "labels", "owner", "name", "low", "high")}
                x = np.frombuffer(r["data"], np.int64).reshape(len(a["ids"]), tree.width)
                asked = Asked(a["ids"], a["tags"], a["labels"], x, a["owner"], a["name"], a["low"], a["high"], alike).bounded(tree, sample, k)
                near, far = asked.annuli(tree)
                out, held = [[] for _ in ASKED.split(", ")], 0
                for leaf, live in tree.leaves_within(x, near, far, asked.owner):
                    if leaf not in parts:
                        continue
                    used, owner = np.unique(asked.owner[live], return_inverse=True)
                    columns = [asked.ids[used], asked.tags[used], asked.labels[used], x[used], owner.astype(np.int64), asked.name[live], asked.low[live], asked.high[live]]
                    packed_up = [np.ascontiguousarray(c).tobytes() for c in columns]
                    for part in range(parts[leaf]):
                        for column, value in zip(out, (leaf, part, *packed_up)):
                            column.append(value)
                        held += sum(map(len, packed_up))
                        if held > MESSAGE:
                            yield _asked(out)
                            out, held = [[] for _ in out], 0
                if out[0]:
                    yield _asked(out)

    return batches


FOUND = "anchor_id long, anchor_tag long, name long, vec_id long, tag long, score long"


def looked_up(width: int, exact: bool, k: int, alike: bool):
    """The k best rows of a part of a leaf for every window."""

    def batches(source):
        for batch in source:
            out = []
            for r in batch.to_pylist():
                a = {c: np.frombuffer(r[c], np.int64) for c in ("a_ids", "a_tags", "a_labels", "a_data", "owner", "name", "low", "high", "ids", "tags", "labels", "data")}
                asked = Asked(a["a_ids"], a["a_tags"], a["a_labels"], a["a_data"].reshape(-1, width), a["owner"], a["name"], a["low"], a["high"], alike)
                scores = products(asked.x, a["data"].reshape(-1, width), exact)[asked.owner]
                row, col = best(scores, asked.allowed(scores, a["ids"], a["labels"]), k)
                owner = asked.owner[row]
                out.append((asked.ids[owner], asked.tags[owner], asked.name[row], a["ids"][col], a["tags"][col], scores[row, col].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=[f.split()[0] for f in FOUND.split(", ")])

    return batches


def anchor_blocks(anchors: DataFrame, width: int, size: int = ANCHORS) -> DataFrame:
    """Anchors (rows with leaf, windows: array of name, low, high) in blocks of about ``size`` from neighbouring leaves."""

    def block(key, table):
        table = table.sort_by([("vec_id", "ascending"), ("tag", "ascending")])
        windows = table.column("windows").to_pylist()
        flat = lambda f: np.array([w[f] for ws in windows for w in ws], dtype=np.int64).tobytes()
        as_bytes = lambda c: table.column(c).to_numpy().astype(np.int64).tobytes()
        return pa.table({
            "ids": [as_bytes("vec_id")], "tags": [as_bytes("tag")], "labels": [as_bytes("label")],
            "data": [matrix(table.column("x").combine_chunks(), width).tobytes()],
            "owner": [np.repeat(np.arange(len(windows)), [len(w) for w in windows]).astype(np.int64).tobytes()],
            "name": [flat("name")], "low": [flat("low")], "high": [flat("high")],
        })

    spark = anchors.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    return in_groups(anchors, size).repartition(tasks, "group", "part").groupBy("group", "part").applyInArrow(
        block, "ids binary, tags binary, labels binary, data binary, owner binary, name binary, low binary, high binary")


def first_in_windows(anchors: DataFrame, index: Index, k: int, alike: bool) -> DataFrame:
    """anchor_id, anchor_tag, name, rank, vec_id, score: the first k rows within each of the anchors' windows.

    Windows and blocks are merged whatever the size of their files: packed rows of copies are small in a file only, and a
    broadcast would hold all of them on the driver."""
    tree = index.tree
    visits = anchor_blocks(anchors, tree.width).mapInArrow(routed(tree, index.parts, index.sample, k, alike), ASKED)
    found = visits.join(index.blocks.hint("merge"), ["leaf", "part"]).mapInArrow(looked_up(tree.width, tree.exact, k, alike), FOUND)
    order = Window.partitionBy("anchor_id", "anchor_tag", "name").orderBy(F.desc("score"), "vec_id", "tag")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Index:
    tree: Tree
    rows: DataFrame  # every row with its leaf
    blocks: DataFrame  # parts of leaves
    parts: dict[int, int]
    sample: tuple[np.ndarray, ...]


def square(x):
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))


def build_index(rows: DataFrame, sample: int = SAMPLE, block: int = BLOCK) -> Index | None:
    """Index of all rows (vec_id, tag, label, x). A sample of at most ``sample`` rows, by hash, chooses the split points;
    every row is dropped into a leaf and counts in the distance ranges."""
    width, top = rows.agg(F.max(F.size("x")), F.max(square(F.col("x")))).first()
    if width is None:
        return None
    some = rows.orderBy(F.xxhash64("tag", "vec_id"), "tag", "vec_id").limit(sample).toArrow()
    x = matrix(some.column("x").combine_chunks(), width)
    tree = grown(x, float(np.sqrt(top)), width, top < EXACT)
    leafed = stage(rows.mapInArrow(dropped(tree), "leaf long, vec_id long, tag long, label long, x array<long>"), "leaves")
    tree = ranged(tree, leafed)
    parts = parts_of(leafed, block)
    blocks = stage(in_parts(leafed, parts).groupBy("leaf", "part").applyInArrow(packed(width), PACKED), "parts")
    order = np.argsort(some.column("vec_id").to_numpy(), kind="stable")
    known = tuple(some.column(c).to_numpy()[order] for c in ("vec_id", "label"))
    return Index(tree, leafed, blocks, parts, (*known, x[order]))


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """The first ``negatives`` rows of another label for each anchor and positive whose score is ``low`` to ``high`` per
    cent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Input: vec_id, embedding, label (a whole number). Anchors are rows whose vec_id is divisible by ``every``; positives an
    anchor's first rows of its label. Components become floor(256 * c), scores are inner products, higher ones first, ties
    by smaller vec_id. Both searches go through the tree: a window of scores is an annulus of distances, a subtree whose
    range misses it at any split point is left out, and leaves are scored exactly. Windows are first cut at the k-th best
    row of the sample, which is a row of the table, so nothing is lost.

    Rows with a null label, null vector or null or non-finite components take no part, nor do rows without vec_id or
    vectors so long that a score of theirs may not fit into a long (components of 10**7 and more). Rows with an anchor's vec_id are not its results; a row repeated with id, vector and label counts once, an id with several
    vectors is several rows; shorter vectors are filled up with zeros. Anchors without positives, and positives without
    rows in their window, give no rows; empty tables none; further columns are ignored.
    """
    spark: SparkSession = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding")).alias("x")).where(
        "vec_id is not null and label is not null and x is not null").where(square(F.col("x")) < float(LONGEST)).distinct()
    index = build_index(stage(usable.withColumn("tag", F.xxhash64("label", "x")).select(*ROW), "usable"), sample, block)
    if index is None:
        return spark.createDataFrame([], OUT)
    anchors = index.rows.where(F.col("vec_id") % every == 0)
    window = lambda name, least, most: F.struct(name.cast("long").alias("name"), least.cast("long").alias("low"), most.cast("long").alias("high"))
    widest = window(F.lit(0), F.lit(-(1 << 62)), F.lit(1 << 62))
    found = stage(first_in_windows(anchors.withColumn("windows", F.array(widest)), index, positives, True).select(
        "anchor_id", "anchor_tag", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    whole, rest = "((positive_score - pmod(positive_score, 100)) div 100)", "pmod(positive_score, 100)"
    least = F.expr(f"{low} * {whole} + (({low} * {rest} + 99) div 100)")  # rounded up
    most = F.expr(f"{high} * {whole} + (({high} * {rest}) div 100)")
    windows = found.withColumn("low", least).withColumn("high", most).where("low <= high").groupBy("anchor_id", "anchor_tag").agg(
        F.collect_list(window(F.col("place"), F.col("low"), F.col("high"))).alias("windows"))  # at most ``positives`` a group
    asked = anchors.join(windows.hint("merge"), (F.col("vec_id") == F.col("anchor_id")) & (F.col("tag") == F.col("anchor_tag"))).select("leaf", *ROW, "windows")
    mined = first_in_windows(asked, index, negatives, False)
    return mined.select("anchor_id", "anchor_tag", F.col("name").alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        found.hint("merge"), ["anchor_id", "anchor_tag", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
