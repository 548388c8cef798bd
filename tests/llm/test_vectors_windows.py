"""Whitening, hard negatives and window dedup against plain Python, with nulls, ties, repeats, empty tables and clashes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlens.llm import gnat, whiten, windows
from bidlens.llm.tables import ship


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    return spark


def whole(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in rng.normal(size=5) * (3, 2, 1, 1, 0.5)]) for i in range(150)]
    rows += [(500 + k, rows[7][1]) for k in range(60)] + [(None, rows[8][1]), (7, rows[7][1]), (7, rows[9][1])]  # a large group of copies
    return rows + [(600, None), (601, [1.0, None]), (602, [float("nan")] * 5), (603, [0.5, -0.25]), (604, [])]


def test_whitening_against_numpy(session):
    rows = odd_vectors()
    df = session.createDataFrame([(i, v, "z", 1.0) for i, v in rows], "vec_id long, embedding array<double>, x string, component double")
    x = [(i, [int(np.floor(256 * c)) for c in v] + [0] * (5 - len(v))) for i, v in rows if whole(v)]
    fit = np.array(sorted(set(map(tuple, (v for _, v in x)))))
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    top = np.argsort(values)[::-1][:4]
    for block in (None, 7):
        got = whiten.whiten(df, block=block).collect()
        assert len(got) == 4 * len(x)
        want = {}
        for i, v in x:
            z = (np.array(v) - sums / n) @ axes[:, top] / np.sqrt(values[top])
            want.setdefault(i, []).append((int(((n * np.array(v) - sums) ** 2).sum()), z))
        sign = {}
        for r in got:
            z = {d: w for d, w in want[r.vec_id]}[r.deviation][r.component - 1]
            assert r.n == n and abs(abs(r.whitened) - abs(z)) < 1e-9 and int(r.deviation_exact) == r.deviation
            if abs(z) > 1e-6:
                assert sign.setdefault(r.component, np.sign(z * r.whitened)) == np.sign(z * r.whitened)
            assert abs(r.explained - values[top[r.component - 1]] / values.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_little(session):
    schema = "vec_id long, embedding array<double>"
    frame = lambda rows: session.createDataFrame(rows, schema)
    assert whiten.whiten(frame([])).collect() == []
    assert whiten.whiten(frame([(1, None), (2, [])])).collect() == []
    assert whiten.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # one distinct vector: no variance
    line = whiten.whiten(frame([(1, [0.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.explained) for r in line) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    far = whiten.whiten(frame([(k, [k * 1e7, 1.0]) for k in range(4)])).where("vec_id = 3").first()
    assert far.deviation is None and int(far.deviation_exact) == (4 * 3 * 2560000000 - 6 * 2560000000) ** 2


def mined(rows, every=50, positives=5, negatives=3):
    """Plain Python; rows: distinct (id, label, whole numbers)."""
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i)
        near = [(j, -s) for s, j, m in scored if m == label][:positives]
        for j, s in near:
            inside = [(k, -t) for t, k, m in scored if m != label and 50 * s <= -100 * t <= 95 * s][:negatives]
            out += [(i, j, r + 1, k, s, t) for r, (k, t) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("spread,copies", [(1.0, 0), (0.1, 300), (2e5, 20)])
def test_hard_negatives_against_brute_force(session, spread, copies):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 2
    rows = []
    for i in range(700):
        rows.append((i, i % 4 if i % 9 else None, [float(c) for c in (centres[i % 6] + rng.normal(size=8)) * spread]))
    rows += [(1000 + k, k % 2, rows[1][2]) for k in range(copies)]  # many ties in one leaf
    rows += [(2000, 1, None), (2050, 1, [1.0, None]), (None, 1, rows[3][2]), rows[50], rows[50], (2100, 2, rows[2][2][:3])]
    df = session.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, tag int, leaf string")
    clean = sorted({(i, m, tuple(int(np.floor(256 * c)) for c in v)) for i, m, v in rows if i is not None and m is not None and whole(v)})
    got = sorted(map(tuple, gnat.mine(df, sample=200, block=64).collect()))
    assert got == mined(clean)


def test_hard_negatives_of_nothing(session):
    df = session.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert gnat.mine(df).collect() == []
    assert gnat.mine(session.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], df.schema)).collect() == []  # no positive


def test_subtrees_are_left_out(session):
    """On well separated groups most leaves are never looked at, though results are those of all rows."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 6)) * 20
    rows = [(i, i % 2, [float(c) for c in centres[i % 40] + rng.normal(size=6) * 0.05]) for i in range(4000)]
    df = session.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    x = df.select("vec_id", "label", gnat.quantised(F.col("embedding")).alias("x")).withColumn("tag", F.xxhash64("label", "x")).select(*gnat.ROW)
    index = gnat.build_index(x, sample=1000)
    widest = F.array(F.struct(F.lit(0).cast("long").alias("name"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    anchors = index.rows.where("vec_id % 50 = 0").withColumn("windows", widest)
    asked = gnat.anchor_blocks(anchors, index.tree.width).mapInArrow(gnat.routed(index.tree, index.parts, index.sample, 5, True), gnat.ASKED)
    read = asked.select((F.length("a_ids") / 8).alias("n")).agg(F.sum("n")).first()[0]
    assert read < 0.35 * 80 * index.tree.leaves


def deduped(rows, length):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - length + 1):
            key = tuple(w[k: k + length])
            first[key] = min(first.get(key, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k: k + length])] < ((1 << 63) - 1 if i is None else i):
                gone[k: k + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_windows_against_plain_python(session):
    rng = random.Random(6)
    few = [f"w{k}" for k in range(6)]  # few words, so that short windows repeat by chance
    many = [f"word{k}é" for k in range(3000)]
    draw = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = draw(many, 40), draw(many, 30_000)
    rows = [(k, draw(few, rng.randint(0, 60))) for k in range(60)]
    rows += [(100 + k, draw(many, 30) + "\n" + passage + "\t" + draw(many, 5)) for k in range(80)]  # one passage in very many texts
    rows += [(300, long), (301, "x " + long[: len(long) // 2]), (302, "z" * 200_000 + " " + passage), (303, None), (304, ""), (305, " \n ")]
    rows += [(None, passage), (None, passage), (None, draw(many, 20)), (150, passage + " again"), (150, draw(few, 50))]  # ids twice
    rows += [(400, rows[70][1])] * 3
    df = session.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, id int, key string, found int").repartition(5)
    for length, base in ((13, 4), (13, 13), (13, 2), (5, 1), (20, 3)):
        got = windows.remove_windows(df, length, base).select(
            "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
        assert sorted(map(tuple, got), key=str) == deduped(rows, length), (length, base)
    spans = windows.remove_windows(df).where("doc_id = 302").first().spans
    assert [(s.start, s.end) for s in spans] == [(1, 41)]


def test_window_levels(session):
    assert windows.levels(4, 13) == [4, 8, 13] and windows.levels(20, 13) == [13] and windows.levels(1, 8) == [1, 2, 4, 8]
    empty = session.createDataFrame([], "doc_id long, text string")
    assert windows.remove_windows(empty).collect() == []
    alone = session.createDataFrame([(1, " ".join(f"a{k}" for k in range(30)))], "doc_id long, text string")
    assert windows.remove_windows(alone).first().n_removed == 0
